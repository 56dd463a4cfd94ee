"""Byte-level BPE: text to token ids and back.

Texts are cut where the published pattern of the vocabulary cuts them, without a
regular expression: each code point gets a class, with what follows it taken into
account, and a class is a function from the state of the scanner before it to the state
after it. Such functions compose, and composition is associative, so a prefix scan
over blocks of code points finds the state at every position. The slices are then
merged pair by pair, lowest rank first, once for each different slice.

Null and empty texts have no tokens. Equal rows give equal rows. Extra columns stay as
they are; ``token_ids``, ``token_ends`` and ``decoded`` replace columns of these names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from faultline.llm.characters import LETTER, NUMBER, OTHER, SPACE, classes, code_points
from faultline.llm.shared import blocks, bounds, gather, lists, slice_hashes

# Kept slices per worker; the memory is emptied when full.
KEPT_SLICES = 1 << 19
# Longer slices are merged with a heap instead of in step with others.
LONG_SLICE = 256
_NEVER = np.int64(1 << 40)

# States of the scanner, named by the slice it is in.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, AFTER_BLANK, ONE_MORE, TWO_MORE = range(8)
# Symbols: the classes, an apostrophe that opens an ending of one or two letters, and
# the last space of a run in front of something else, blank or not.
SHORT_ENDING, LONG_ENDING, LAST_BLANK, LAST_SPACE = range(4, 8)
# The endings that are slices of their own after an apostrophe (fixed values).
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")
_BLOCK = 64


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a slice begins here" by symbol and state; 8 to 15 begin a text."""
    after = np.zeros((16, 8), np.uint8)
    begins = np.zeros((16, 8), bool)
    own = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SPACE: IN_SPACES,
           LAST_BLANK: AFTER_BLANK, LAST_SPACE: FRESH}
    for symbol in range(8):
        for state in range(8):
            ending = symbol in (SHORT_ENDING, LONG_ENDING)
            plain = OTHER if ending else symbol
            if state in (ONE_MORE, TWO_MORE):
                begin, to = False, (FRESH if state == ONE_MORE else ONE_MORE)
            elif plain in (LETTER, NUMBER, OTHER) and state in (AFTER_BLANK, own[plain]):
                begin, to = False, own[plain]
            elif symbol == SPACE and state == IN_SPACES:
                begin, to = False, IN_SPACES
            elif ending:
                begin, to = True, (ONE_MORE if symbol == SHORT_ENDING else TWO_MORE)
            else:
                begin, to = True, own[plain]
            after[symbol, state], begins[symbol, state] = to, begin
    after[8:], begins[8:] = after[:8, FRESH, None], True
    return after.ravel(), begins.ravel()


_AFTER, _BEGINS = _machine()


def _symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of each code point; ``first`` holds where texts begin, and the end."""
    n = len(points)
    kinds = classes()[points]
    border = np.zeros(n + 4, bool)
    border[first] = True
    border[n:] = True
    ahead = np.append(points, np.zeros(3, np.uint32))
    symbols = kinds.copy()
    kinds = np.append(kinds, SPACE)
    last = (kinds[:n] == SPACE) & (kinds[1:] != SPACE) & ~border[1 : n + 1]
    symbols[last] = np.where(points[last] == 32, LAST_BLANK, LAST_SPACE)
    quotes = np.flatnonzero(points == ord("'"))
    quotes = quotes[~border[quotes + 1]]
    one, two = ahead[quotes + 1], ahead[quotes + 2]
    symbols[quotes[np.isin(one, [ord(c) for c in SHORT_ENDINGS])]] = SHORT_ENDING
    pair = (one == ord(LONG_ENDINGS[0][0])) & (two == ord(LONG_ENDINGS[0][1]))
    for a, b in LONG_ENDINGS[1:]:
        pair |= (one == ord(a)) & (two == ord(b))
    symbols[quotes[pair & ~border[quotes + 2]]] = LONG_ENDING
    begin = first[:-1][first[:-1] < first[1:]]
    symbols[begin] += 8
    return symbols


def slice_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the slices of texts begin, by a scan of transition functions."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    count = -(-n // _BLOCK)
    symbols = np.full(count * _BLOCK, SPACE, np.uint8)
    symbols[:n] = _symbols(points, first)
    steps = np.ascontiguousarray(symbols.reshape(count, _BLOCK).T) * np.uint8(8)
    # The function of each block, by its value for each state.
    whole = np.broadcast_to(np.arange(8, dtype=np.uint8), (count, 8))
    for step in steps:
        whole = _AFTER[step[:, None] + whole]
    # Functions of all blocks up to each one, in rounds of doubling reach.
    reach = 1
    while reach < count:
        joined = whole.copy()
        joined[reach:] = np.take_along_axis(whole[reach:], whole[:-reach].astype(np.intp), axis=1)
        whole, reach = joined, reach * 2
    state = np.concatenate([[np.uint8(FRESH)], whole[:-1, FRESH]])
    begins = np.empty((_BLOCK, count), bool)
    for k, step in enumerate(steps):
        at = step + state
        begins[k], state = _BEGINS[at], _AFTER[at]
    return np.flatnonzero(begins.T.ravel()[:n])


def read_ranks(raw: bytes) -> list[bytes]:
    """Tokens by rank from the lines of a rank file."""
    pairs = (line.split() for line in raw.splitlines() if line)
    ranked = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranked[k] for k in range(len(ranked))]


class Vocabulary:
    """Ranks of one file, with the merges they stand for and a memory of slices."""

    def __init__(self, tokens: list[bytes]):
        self.ranks = {token: rank for rank, token in enumerate(tokens)}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        merges = {}
        for rank, token in enumerate(tokens):
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    merges[left << 32 | right] = rank
        keys = np.fromiter(merges, np.int64, len(merges))
        order = np.argsort(keys)
        self.pairs = np.append(keys[order], np.int64(1) << 62)
        self.merged = np.append(np.fromiter(merges.values(), np.int64, len(merges))[order], _NEVER)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = bounds(self.lengths)[:-1]
        decimals = [b"%d " % k for k in range(len(tokens))]
        self.decimal_bytes = np.frombuffer(b"".join(decimals), np.uint8)
        self.decimal_lengths = np.array([len(d) for d in decimals], np.int64)
        self.decimal_starts = bounds(self.decimal_lengths)[:-1]
        self.forget()

    def forget(self) -> None:
        self.rows: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.used = 0

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbours make, or a value above all ranks."""
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.merged[at], _NEVER)

    def merge_together(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge many slices in step: in each round the lowest, leftmost pair of each."""
        owner = np.repeat(np.arange(len(counts)), counts)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        cost = np.full(len(symbols), _NEVER)
        if len(symbols) > 1:
            cost[:-1] = self.ranks_of(symbols[:-1], symbols[1:])
            cost[:-1][owner[:-1] != owner[1:]] = _NEVER
        while len(symbols):
            head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(cost, head)
            sizes = np.diff(np.append(head, len(symbols)))
            low = np.repeat(lowest, sizes)
            over = low == _NEVER
            if over.any():
                done.append((owner[over], symbols[over]))
                stay = ~over
                symbols, owner, cost, low = symbols[stay], owner[stay], cost[stay], low[stay]
                if not len(symbols):
                    break
            hit = np.flatnonzero(cost == low)
            hit = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])]
            symbols[hit] = cost[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            at = np.cumsum(keep)[hit] - 1
            symbols, owner, cost = symbols[keep], owner[keep], cost[keep]
            for place in (at, at - 1):
                ok = (place >= 0) & (place + 1 < len(symbols))
                ok[ok] = owner[place[ok]] == owner[place[ok] + 1]
                cost[place[(place >= 0) & ~ok]] = _NEVER
                place = place[ok]
                cost[place] = self.ranks_of(symbols[place], symbols[place + 1])
        owner = np.concatenate([o for o, _ in done]) if done else np.zeros(0, np.int64)
        symbols = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(counts))

    def merge_long(self, piece: bytes) -> list[int]:
        """Merge one long slice with a heap of its pairs."""
        n = len(piece)
        parts: list[bytes | None] = [piece[k : k + 1] for k in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, 2) for k in range(n - 1) if (r := self.ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, size = heapq.heappop(heap)
            right = after[k]
            if parts[k] is None or right >= n or len(parts[k]) + len(parts[right]) != size:
                continue
            parts[k], parts[right] = parts[k] + parts[right], None
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
            for left in (k, before[k]):
                if left >= 0 and after[left] < n:
                    both = parts[left] + parts[after[left]]
                    if (r := self.ranks.get(both)) is not None:
                        heapq.heappush(heap, (r, left, len(both)))
        return [self.ranks[p] for p in parts if p is not None]

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: list[int]) -> None:
        """Add the ids of slices not met so far."""
        pieces = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids: list = [[r] if (r := self.ranks.get(p)) is not None else None for p in pieces]
        short = []
        for k, p in enumerate(pieces):
            if ids[k] is None:
                if len(p) > LONG_SLICE:
                    ids[k] = self.merge_long(p)
                else:
                    short.append(k)
        if short:
            raw = np.frombuffer(b"".join(pieces[k] for k in short), np.uint8)
            lengths = np.array([len(pieces[k]) for k in short], np.int64)
            merged, counts = self.merge_together(self.single[raw], lengths)
            cut = bounds(counts).tolist()
            merged = merged.tolist()
            for j, k in enumerate(short):
                ids[k] = merged[cut[j] : cut[j + 1]]
        counts = np.array([len(i) for i in ids], np.int64)
        flat = np.array([i for x in ids for i in x], np.int32)
        row, total = len(self.rows), len(flat)
        while row + len(ids) > len(self.begin):
            self.begin, self.count = np.append(self.begin, self.begin * 0), np.append(self.count, self.count * 0)
        while self.used + total > len(self.flat):
            self.flat = np.append(self.flat, self.flat * 0)
        self.flat[self.used : self.used + total] = flat
        self.begin[row : row + len(ids)] = self.used + bounds(counts)[:-1]
        self.count[row : row + len(ids)] = counts
        self.used += total
        self.rows.update(zip(hashes, range(row, row + len(ids)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of texts end to end, and how many each text has."""
        points, begins, first = code_points(data, offsets)
        starts = begins[slice_starts(points, first)] if len(points) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        different, at, back = np.unique(slice_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.rows) + len(different) > KEPT_SLICES:
            self.forget()
        hashes = different.tolist()
        missing = np.flatnonzero(np.fromiter((h not in self.rows for h in hashes), bool, len(hashes)))
        if len(missing):
            self._learn(data, starts[at[missing]], ends[at[missing]], [hashes[k] for k in missing.tolist()])
        rows = np.fromiter((self.rows[h] for h in hashes), np.int64, len(hashes))[back]
        counts = self.count[rows]
        ids = self.flat[gather(self.begin[rows], counts)]
        per_text = np.diff(bounds(counts)[np.searchsorted(starts, offsets)])
        return ids, per_text

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens, end to end."""
        return self.bytes[gather(self.starts[ids], self.lengths[ids])]

    def decimals(self, ids: np.ndarray) -> np.ndarray:
        """The ids as decimal numbers, each with a space after it."""
        return self.decimal_bytes[gather(self.decimal_starts[ids], self.decimal_lengths[ids])]


_LOADED: dict[bytes, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """One vocabulary per worker process, whatever the number of tasks."""
    if shared.value not in _LOADED:
        _LOADED.clear()
        _LOADED[shared.value] = Vocabulary(read_ranks(shared.value))
    return _LOADED[shared.value]


def share_ranks(spark: SparkSession, path: str):
    """The rank file, read once on the driver; its size is that of a vocabulary."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _appended(rows: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [n for n in rows.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays(
        [rows.column(rows.schema.get_field_index(n)) for n in kept] + list(columns.values()),
        names=kept + list(columns),
    )


def encode_batches(batches: Iterator[pa.RecordBatch], shared, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Add the token ids of each text, and the byte of the text at which each token ends."""
    words = _vocabulary(shared)
    for block in blocks(batches, text):
        ids, counts = words.encode(block.data, block.offsets)
        ends = np.cumsum(words.lengths[ids]) - np.repeat(block.offsets[:-1], counts)
        yield _appended(
            block.rows,
            {"token_ids": lists(ids, counts, pa.int32()), "token_ends": lists(ends.astype(np.int32), counts)},
        )


def decode_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Add the bytes that the token ids of each row stand for; null ids give none."""
    words = _vocabulary(shared)
    for batch in batches:
        ids, counts = _ids(batch)
        size = bounds(words.lengths[ids])[bounds(counts)]
        offsets = pa.array(size.astype(np.int64)).buffers()[1]
        raw = pa.py_buffer(words.decode(ids).tobytes())
        decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, offsets, raw])
        yield _appended(batch, {"decoded": decoded.cast(pa.binary())})


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(batch.schema.get_field_index("token_ids"))
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts


def _with(schema: T.StructType, **columns: T.DataType) -> T.StructType:
    kept = [f for f in schema if f.name not in columns]
    return T.StructType(kept + [T.StructField(n, t) for n, t in columns.items()])


def encode(docs: DataFrame, ranks: str, text: str = "text") -> DataFrame:
    """Every row with ``token_ids`` and ``token_ends`` of its whole text (null: empty)."""
    shared = share_ranks(docs.sparkSession, ranks)
    schema = _with(docs.schema, token_ids=T.ArrayType(T.IntegerType()), token_ends=T.ArrayType(T.IntegerType()))
    return docs.mapInArrow(lambda batches: encode_batches(batches, shared, text), schema)


def decode(docs: DataFrame, ranks: str) -> DataFrame:
    """Every row with the bytes ``decoded`` from its ``token_ids``."""
    shared = share_ranks(docs.sparkSession, ranks)
    schema = _with(docs.schema, decoded=T.BinaryType())
    return docs.mapInArrow(lambda batches: decode_batches(batches, shared), schema)


def digests(docs: DataFrame, ranks: str) -> DataFrame:
    """Encode, decode the ids again, and return digests of both per document.

    Columns: doc_id, n_tokens, ids_sha256 (decimal ids joined by a space) and
    decoded_sha256 (decoded bytes).
    """
    shared = share_ranks(docs.sparkSession, ranks)

    def run(batches):
        for batch in decode_batches(encode_batches(batches, shared), shared):
            ids, counts = _ids(batch)
            words = _vocabulary(shared)
            text = words.decimals(ids).tobytes()
            at = bounds(words.decimal_lengths[ids])[bounds(counts)].tolist()
            listed = [hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
            raw = [hashlib.sha256(b).hexdigest() for b in batch.column("decoded").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), pa.array(listed, pa.string()), pa.array(raw, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
