"""Removal of passages that an earlier document has, by Aho-Corasick automata.

A window is 13 consecutive words of one document. A word goes if a window over it has
the same words as one that starts in a document with a smaller id. Windows are judged on the input.

1. Copies. Of documents with the same words all but the first lose every word that
   a window covers, which is all or none. They take no further part, since the first has
   their windows.
2. Anchors. Among the five-word runs of a window the one with the smallest hash is its
   anchor, so equal windows have equal anchors, and neighbouring windows mostly share
   theirs. Anchors found in two different texts or more are counted out over the corpus.
3. Segments. Neighbouring windows with one recurring anchor are a segment of 13 to 21
   words. Equal segments become one row, with the first and last document, before they meet.
4. Automata. Segments are dealt to shards by anchor, so equal windows always meet in
   one shard. There the windows that several documents have are confirmed, runs of
   them with the same first document are compiled into one automaton, and all segments of
   the shard are streamed through it, which locates every occurrence. An
   anchor with very many segments is spread over several shards; its windows are
   confirmed over all of them beforehand.
5. Occurrences go back to the documents that hold the segment.

A null text has no words. A row without id is neither earlier nor later than another
and stays whole. Rows with one id are one document as to order, and each is returned. Other
columns are not read. Texts are told apart by a 64-bit hash and their number of words,
segments by two 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from faultline.llm.shared import Block, blocks, bounds, discard, gather, lists, mix, signed, slice_hashes, written

WINDOW = 13
RUN = 5
# Segments of one shard, about; beyond a quarter of it an anchor is spread.
SHARD_SEGMENTS = 16_000


class Windows:
    """The windows of the texts of a block: their anchors and where these lie."""

    def __init__(self, block: Block):
        self.starts, self.ends, self.first = block.words()
        hashes = slice_hashes(block.data, self.starts, self.ends)
        count = len(hashes) - WINDOW + 1
        self.at = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        if count > 0:
            n, factor = len(hashes) - RUN + 1, 1
            total = np.zeros(n, np.uint64)
            for k in range(RUN):
                factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
                total += hashes[k : k + n] * np.uint64(factor)
            total = mix(total)
            view = np.lib.stride_tricks.sliding_window_view(total, WINDOW - RUN + 1)
            least = view.argmin(axis=1)
            owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
            self.at = np.flatnonzero(owner[:count] == owner[WINDOW - 1 :])
            self.place = self.at + least[self.at]
            self.anchor = total[self.place]
        # The number of the first window of each text.
        self.begin = np.searchsorted(self.at, self.first)

    def different(self, k: int) -> np.ndarray:
        return np.unique(self.anchor[self.begin[k] : self.begin[k + 1]])


def _row_key(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_words, anchors) of documents with an id."""

    def run(batches):
        for block in blocks(batches):
            found = Windows(block)
            data, begin = _spaced(block, found)
            count = len(found.first) - 1
            each = [found.different(k) for k in range(count)]
            yield pa.RecordBatch.from_arrays(
                [
                    block.rows.column("doc_id"),
                    pa.array([_row_key(_text(data, begin, found, k)) for k in range(count)], pa.int64()),
                    pa.array(np.diff(found.first)),
                    lists(signed(np.concatenate(each)), np.array([len(e) for e in each])),
                ],
                names=["doc_id", "row", "n_words", "anchors"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(
        run, f"doc_id {kind}, row long, n_words long, anchors array<long>"
    )


_SEGMENT = pa.struct([("anchor", pa.int64()), ("start", pa.int32()), ("text", pa.string())])


def _spaced(block: Block, words: Windows) -> tuple[np.ndarray, np.ndarray]:
    """The words of a block with one space after each, and where each word begins in them."""
    size = words.ends - words.starts + 1
    places = gather(words.starts, size)
    data = block.data[np.minimum(places, len(block.data) - 1)] if len(places) else np.zeros(0, np.uint8)
    begin = bounds(size)
    data[begin[1:] - 1] = 32
    return data, begin


def _text(data: np.ndarray, begin: np.ndarray, words: Windows, k: int) -> bytes:
    """The words of text k, joined by a space."""
    a, b = begin[words.first[k]], begin[words.first[k + 1]]
    return data[a : max(a, b - 1)].tobytes()


def _prepared(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per row its digest as it is, and the segments of its recurring anchors.

    Rows with segments carry their words, joined by a space. A later copy has lost its
    words already.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = known.withColumnRenamed("row", "known")
    both = docs.select("doc_id", "text").join(ids, "doc_id", "left")
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for block in blocks(batches):
            words = Windows(block)
            data, begin = _spaced(block, words)
            listed = block.rows.column("anchors")
            cut = bounds(listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            anchors = listed.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            expected, copies = block.rows.column("known").to_pylist(), block.rows.column("copy").to_pylist()
            keep, rows, digests, texts, removed, counts, pieces = [], [], [], [], [], [], []
            for k, want in enumerate(expected):
                text = _text(data, begin, words, k)
                row = _row_key(text)
                # An id with several texts meets the knowledge of each; only its own counts.
                if want is not None and want != row:
                    continue
                lo, hi = words.begin[k], words.begin[k + 1]
                own = anchors[cut[k] : cut[k + 1]]
                mine = np.isin(words.anchor[lo:hi], own) if len(own) else np.zeros(hi - lo, bool)
                keep.append(k)
                rows.append(row)
                removed.append(int(words.first[k + 1] - words.first[k]) if copies[k] else 0)
                digests.append(nothing if copies[k] else hashlib.sha256(text).hexdigest())
                texts.append(text.decode() if mine.any() else None)
                # Segments: windows in a row with one anchor at one place.
                change = words.place[lo:hi][1:] != words.place[lo:hi][:-1]
                head = np.flatnonzero(mine & np.append(True, change)[: hi - lo])
                tail = np.flatnonzero(mine & np.append(change, True)[: hi - lo])
                counts.append(len(head))
                pieces.append((words.at[lo:hi][head], words.at[lo:hi][tail], words.anchor[lo:hi][head], words.first[k]))
            if not keep:
                continue
            head = np.concatenate([p[0] for p in pieces])
            tail = np.concatenate([p[1] for p in pieces])
            start = head - np.repeat([p[3] for p in pieces], counts)
            size = begin[tail + WINDOW] - 1 - begin[head]
            raw = pa.py_buffer(data[gather(begin[head], size)].tobytes())
            offsets = pa.array(bounds(size).astype(np.int32)).buffers()[1]
            segment = pa.StructArray.from_arrays(
                [
                    pa.array(signed(np.concatenate([p[2] for p in pieces]))),
                    pa.array(start.astype(np.int32)),
                    pa.StringArray.from_buffers(len(head), offsets, raw),
                ],
                fields=list(_SEGMENT),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    block.rows.column("doc_id").take(pa.array(keep)),
                    pa.array(rows, pa.int64()),
                    pa.array(np.diff(words.first)[keep]),
                    pa.array(removed, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(texts, pa.string()),
                    pa.ListArray.from_arrays(pa.array(bounds(np.array(counts)).astype(np.int32)), segment),
                ],
                names=["doc_id", "row", "n_words", "n_removed", "digest", "words", "segments"],
            )

    return both.mapInArrow(
        run,
        f"doc_id {kind}, row long, n_words long, n_removed long, digest string, words string,"
        " segments array<struct<anchor: long, start: int, text: string>>",
    )


def _windows(words: list) -> list[tuple]:
    return [tuple(words[k : k + WINDOW]) for k in range(len(words) - WINDOW + 1)]


def _occurrences(segments: pa.Table, spread: pa.Table, kind: pa.DataType) -> pa.Table:
    """Confirm the windows of a shard, compile them and locate them in all its segments."""
    number: dict[str, int] = {}
    columns = [segments.column(n).to_pylist() for n in ("anchor", "segment", "text", "least", "most")]
    texts = [
        (anchor, segment, tuple([number.setdefault(w, len(number)) for w in text.split(" ")]), least, most)
        for anchor, segment, text, least, most in zip(*columns, strict=True)
    ]
    # First and last document of each window; those of spread anchors come confirmed.
    seen: dict[tuple, list] = {}
    for window, first in zip(spread.column("window").to_pylist(), spread.column("first").to_pylist(), strict=True):
        seen[tuple([number.get(w, -1) for w in window.split(" ")])] = [first, None]
    wide = set(spread.column("anchor").to_pylist())
    for anchor, _, word, least, most in texts:
        if anchor not in wide:
            for window in _windows(word):
                both = seen.setdefault(window, [least, most])
                both[0], both[1] = min(both[0], least), max(both[1], most)
    patterns = set()
    for anchor, _, word, _, _ in texts:
        found = [
            both[0] if (both := seen.get(window)) and (both[1] is None or both[0] < both[1]) else None
            for window in _windows(word)
        ]
        # Windows in a row with one first document make one passage.
        at = 0
        while at < len(found):
            to = at + 1
            while to < len(found) and found[to] == found[at]:
                to += 1
            if found[at] is not None:
                patterns.add((word[at : to + WINDOW - 1], found[at]))
            at = to
    out: tuple[list, ...] = ([], [], [], [], [])
    if patterns:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, first in patterns:
            automaton.add_word(pattern, (len(pattern), first))
        automaton.make_automaton()
        for anchor, segment, word, _, most in texts:
            for end, (size, first) in automaton.iter(word):
                # A passage whose first document is the last with this segment is its own.
                if first < most:
                    for column, value in zip(out, (anchor, segment, end - size + 1, size, first), strict=True):
                        column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), kind)
    return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["anchor", "segment", "offset", "size", "first"])


def _located(segments: DataFrame) -> DataFrame:
    """(anchor, segment, offset, size, first) of every confirmed passage in every segment."""
    shards = 1 + segments.count() // SHARD_SEGMENTS
    most = max(1, SHARD_SEGMENTS // 4)
    wide = (
        segments.groupBy("anchor").count().where(f"count > {most}")
        .selectExpr("anchor", f"1 + count div {most} AS spread")
    )
    wide = written(wide, "wide")
    shard = F.pmod("anchor", F.lit(shards)).alias("shard")
    dealt = segments.join(wide, "anchor", "left").select(
        shard, F.expr("pmod(segment, coalesce(spread, 1))").alias("part"), "anchor", "segment", "text", "least", "most"
    )
    # Only anchors that are spread need their windows counted over all segments.
    windows = f"transform(sequence(1, size(w) - {WINDOW - 1}), i -> array_join(slice(w, i, {WINDOW}), ' '))"
    confirmed = (
        segments.join(wide, "anchor")
        .selectExpr("anchor", "spread", "least", "most", "split(text, ' ') AS w")
        .selectExpr("anchor", "spread", "least", "most", f"explode({windows}) AS window")
        .groupBy("anchor", "spread", "window").agg(F.min("least").alias("first"), F.max("most").alias("last"))
        .where("first < last")
        .select(shard, F.expr("explode(sequence(0, spread - 1))").alias("part"), F.col("anchor").alias("anchor"), "window", "first")
    )
    name = segments.schema["least"].dataType.simpleString()
    kind = to_arrow_type(segments.schema["least"].dataType)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _occurrences(left, right, kind)

    return dealt.groupBy("shard", "part").cogroup(confirmed.groupBy("shard", "part")).applyInArrow(
        run, f"anchor long, segment long, offset int, size int, first {name}"
    )


def _cleaned(rows: DataFrame) -> DataFrame:
    """The final columns of rows whose removed ranges are known."""

    def run(batches: Iterator[pa.RecordBatch]):
        for block in blocks(batches, "words"):
            starts, ends, first = block.words()
            removed, digests = [], []
            for k, ranges in enumerate(block.rows.column("ranges").to_pylist()):
                lo, hi = first[k], first[k + 1]
                change = np.zeros(hi - lo + 1, np.int64)
                if ranges:
                    np.add.at(change, [r["start"] for r in ranges], 1)
                    np.add.at(change, [r["start"] + r["size"] for r in ranges], -1)
                keep = np.cumsum(change)[:-1] == 0
                size = (ends[lo:hi] - starts[lo:hi] + 1)[keep]
                places = gather(starts[lo:hi][keep], size)
                data = block.data[np.minimum(places, len(block.data) - 1)]
                data[np.cumsum(size) - 1] = 32
                removed.append(int((~keep).sum()))
                digests.append(hashlib.sha256(data[:-1].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [block.rows.column("doc_id"), block.rows.column("n_words"), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def occurrences(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prepared rows, and (doc_id, row, ranges) of the words that earlier documents have."""
    anchors = written(_anchors(docs), "anchors")
    rows = anchors.select("row", F.explode("anchors").alias("anchor"))
    seen = rows.groupBy("anchor").agg(F.min("row").alias("least"), F.max("row").alias("most")).where("least < most")
    # Written, so that Spark can split the rows of an anchor that very many texts have.
    seen = written(seen.select("anchor"), "seen")
    hits = rows.join(seen, "anchor", "left_semi").groupBy("row").agg(F.collect_set("anchor").alias("anchors"))
    origins = anchors.groupBy("row", "n_words").agg(F.min("doc_id").alias("origin"))
    firsts = origins.join(hits, "row", "left")
    known = (
        anchors.select("doc_id", "row", "n_words").distinct().join(firsts, ["row", "n_words"])
        .select("doc_id", "row", F.expr(f"doc_id > origin AND n_words >= {WINDOW}").alias("copy"),
                F.when(F.col("doc_id") == F.col("origin"), F.col("anchors")).alias("anchors"))
    )
    known = written(known, "known")
    discard(anchors, seen)
    prepared = written(_prepared(docs, known), "prepared")
    discard(known)
    places = prepared.select("doc_id", "row", F.inline("segments")).withColumn("segment", F.xxhash64("text"))
    segments = written(
        places.groupBy("anchor", "segment")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("text").alias("text")),
        "segments",
    )
    located = written(_located(segments), "located")
    discard(segments)
    ranges = (
        places.select("anchor", "segment", "doc_id", "row", "start")
        .join(located, ["anchor", "segment"]).where("first < doc_id")
        .groupBy("doc_id", "row")
        .agg(F.collect_set(F.struct((F.col("start") + F.col("offset")).alias("start"), "size")).alias("ranges"))
    )
    return prepared, ranges


def remove_repeated(docs: DataFrame) -> DataFrame:
    """Every document with n_words, n_removed and the digest of the words that stay, joined by a space."""
    prepared, ranges = occurrences(docs)
    found = written(ranges, "ranges")
    keys = found.select("doc_id", "row")
    whole = prepared.select("doc_id", "row", "n_words", "n_removed", "digest").join(keys, ["doc_id", "row"], "left_anti")
    changed = prepared.where("words IS NOT NULL").select("doc_id", "row", "n_words", "words").join(found, ["doc_id", "row"])
    return whole.selectExpr("doc_id", "n_words", "n_removed", "digest AS kept_sha256").unionByName(_cleaned(changed))
