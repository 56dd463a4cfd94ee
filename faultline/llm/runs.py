"""Runs: stretches of words that repeat with a period, found exactly.

The words of a block of texts become numbers, and the texts follow each other, each behind a border of its
own, then once more backwards. Of this sequence only the suffixes at positions in a difference cover are
sorted: any two positions are moved into the cover together by a shift below its modulus. How far
two positions agree is then known from a few words up to that shift, and from there
from the least common prefix between two places in the sorted order, which a sparse table gives.

A run with period q is a longest stretch in which words q apart are equal, so it shows as a stretch of
matches between the text and itself moved by q. Such a stretch is as long as the shortest run asks for,
so a grid of that width cannot miss it; the grids of all periods together have n log n
points. A point with a match is followed forwards and backwards to both ends of its stretch. The same stretch
under a multiple of its period is listed once, with the smallest period.

Each text is handled in its own row, in blocks of about a megabyte, so nothing is shuffled. A null text has no words, as an
empty one. Null ids, repeated rows and empty tables need no rule. Columns named as the new ones
are replaced. Memory grows with the longest text alone, by about 120 bytes a word.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.shared import SPLIT, Block, blocks, bounds, gather, lists

# A run holds its period at least so often, and has at least so many words.
REPEATS = 4
LEAST_WORDS = 6
# A difference cover: every number below the modulus is the difference of two members (fixed values).
MODULUS = 31
COVER = (1, 5, 11, 24, 25, 27)
# Grid points looked at together.
POINTS = 1 << 20

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _shifts() -> np.ndarray:
    """For two remainders, the least shift that moves both into the cover."""
    member = np.zeros(MODULUS, bool)
    member[list(COVER)] = True
    moved = member[(np.arange(MODULUS)[:, None] + np.arange(MODULUS)) % MODULUS]
    return np.argmax(moved[:, None, :] & moved[None, :, :], axis=2)


_SHIFTS = _shifts()


class Agreement:
    """How many values agree from two positions on, for a sequence in which some value ends every agreement."""

    def __init__(self, values: np.ndarray):
        # Padding ends the last suffixes; no value is negative.
        self.values = np.concatenate([values, np.full(MODULUS + 1, -1, np.int64)])
        self.length = len(values)
        spots = np.arange(self.length)
        self.at = spots[np.isin(spots % MODULUS, COVER)]
        # The sample that stands at a position, or none.
        self.sample = np.full(self.length + MODULUS, -1, np.int64)
        self.sample[self.at] = np.arange(len(self.at))
        self._sort()
        self._prefixes()

    def _refine(self, rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Split tied groups by a key; the ranks change in place, and those still tied are returned."""
        order = np.lexsort((key, rank[tied]))
        tied, key = tied[order], key[order]
        old = rank[tied]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (old[1:] != old[:-1]) | (key[1:] != key[:-1])
        group = np.ones(len(tied), bool)
        group[1:] = old[1:] != old[:-1]
        spots = np.arange(len(tied))
        begin = np.maximum.accumulate(np.where(group, spots, 0))
        own = np.maximum.accumulate(np.where(fresh, spots, 0))
        rank[tied] = old + own - begin
        alone = fresh & np.append(fresh[1:], True)
        return tied[~alone]

    def _after(self, rank: np.ndarray, who: np.ndarray, shift: int) -> np.ndarray:
        """Ranks of the samples that stand ``shift`` after others; -1 behind the end."""
        spot = self.at[who] + shift
        inside = spot < self.length
        return np.where(inside, rank[self.sample[np.where(inside, spot, 0)]], -1)

    def _sort(self) -> None:
        """Ranks of sampled suffixes: by words up to the modulus, then by doubling."""
        rank, tied = np.zeros(len(self.at), np.int64), np.arange(len(self.at))
        bits = max(1, int(self.values.max(initial=0) + 2).bit_length())
        step = max(1, 62 // bits)
        for done in range(0, MODULUS, step):
            if not len(tied):
                break
            key = np.zeros(len(tied), np.int64)
            for k in range(done, min(done + step, MODULUS)):
                key = key << bits | (self.values[np.minimum(self.at[tied] + k, self.length)] + 1)
            tied = self._refine(rank, tied, key)
        self.levels, shift = [], MODULUS
        while len(tied):
            self.levels.append(rank.astype(np.int32 if len(rank) < 1 << 31 else np.int64))
            tied = self._refine(rank, tied, self._after(rank, tied, shift))
            shift *= 2
        self.rank = rank

    def _prefixes(self) -> None:
        """Common prefixes of neighbours in the order, and their minima over spans of 2^k."""
        order = np.empty(len(self.at), np.int64)
        order[self.rank] = np.arange(len(self.at))
        a, b = self.at[order[:-1]], self.at[order[1:]]
        total = np.zeros(len(a), np.int64)
        # Samples with equal ranks at a level agree in as many words as the level covers.
        for k in range(len(self.levels) - 1, -1, -1):
            inside = (a < self.length) & (b < self.length)
            one, two = (self.sample[np.where(inside, x, self.at[0])] for x in (a, b))
            same = inside & (self.levels[k][one] == self.levels[k][two])
            jump = np.where(same, MODULUS << k, 0)
            total, a, b = total + jump, a + jump, b + jump
        total += self._words(a, b, np.full(len(a), MODULUS))
        self.minima = [total.astype(np.int32)]
        while (width := 1 << len(self.minima)) <= len(total):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[: len(total) - width + 1], last[width // 2 :][: len(total) - width + 1]))

    def _words(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words agree, looking at ``most`` of them."""
        out, going, step = np.zeros(len(a), np.int64), np.arange(len(a)), 0
        while len(going):
            going = going[most[going] > step]
            left, right = (np.minimum(x[going] + step, self.length) for x in (a, b))
            going = going[(self.values[left] == self.values[right]) & (left < self.length) & (right < self.length)]
            step += 1
            out[going] = step
        return out

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Agreement of pairs of different positions."""
        shift = _SHIFTS[a % MODULUS, b % MODULUS]
        out = self._words(a, b, shift)
        far = np.flatnonzero(out == shift)
        one, two = (self.rank[self.sample[x[far] + shift[far]]] for x in (a, b))
        low, high = np.minimum(one, two), np.maximum(one, two)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            of = level == k
            least = np.minimum(self.minima[k][low[of]], self.minima[k][high[of] - (1 << int(k))])
            out[far[of]] += least
        return out


def find(words: np.ndarray, first: np.ndarray, repeats: int = REPEATS, least: int = LEAST_WORDS):
    """Runs of texts whose numbered words stand end to end, text k from ``first[k]`` to ``first[k + 1]``.

    Arrays of text, start, length and period, by text, start and period.
    """
    sizes = np.diff(first)
    texts, total = len(sizes), int(first[-1])
    nothing = tuple(np.zeros(0, np.int64) for _ in range(4))
    if total == 0:
        return nothing
    # A border before each text and at the end, other ones backwards, all different.
    spot = np.arange(total) + np.repeat(np.arange(texts), sizes) + 1
    width = total + texts + 1
    forward = int(words.max()) + 1 + np.cumsum(np.ones(width, np.int64))
    backward = forward[::-1] + width
    forward[spot] = words
    mirrored = 2 * width - 1 - spot
    both = np.concatenate([forward, backward])
    both[mirrored] = words
    agree = Agreement(both)

    # Of each text, every period that leaves room for a run, and its grid.
    most = np.where(sizes >= least, sizes // repeats, 0)
    owner = np.repeat(np.arange(texts), most)
    period = np.arange(len(owner)) - np.repeat(bounds(most)[:-1], most) + 1
    width_of = np.maximum(least, repeats * period) - period
    points = (sizes[owner] - period - 1) // width_of + 1
    begin = first[:-1] + np.arange(texts) + 1
    found = []
    ends = np.cumsum(points)
    cut = 0
    while cut < len(owner):
        done = ends[cut - 1] if cut else 0
        to = max(cut + 1, int(np.searchsorted(ends, done + POINTS, side="right")))
        part = slice(cut, to)
        nth = gather(np.zeros(to - cut, np.int64), points[part])
        q = np.repeat(period[part], points[part])
        at = np.repeat(begin[owner[part]], points[part]) + nth * np.repeat(width_of[part], points[part])
        hit = forward[at] == forward[at + q]
        at, q = at[hit], q[hit]
        text = np.repeat(owner[part], points[part])[hit]
        right = agree(at, at + q)
        # Backwards from the words before both positions; the border before a text has a mirror too.
        left = agree(2 * width - at, 2 * width - at - q)
        whole = left + right >= np.maximum(least, repeats * q) - q
        found.append(np.stack([text, at - left - begin[text], left + right + q, q], axis=1)[whole])
        cut = to
    if not found:
        return nothing
    # Smallest period of each stretch.
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :3] != runs[:-1, :3]).any(axis=1)
    runs = runs[new]
    runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
    return tuple(runs.T)


class _Words:
    """Words of a block, their numbers, and the runs of its texts."""

    def __init__(self, block: Block, repeats: int, least: int):
        starts, ends, self.first = block.words()
        sizes = ends - starts
        taken = block.data[gather(starts, sizes)]
        self.words = pa.Array.from_buffers(
            pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds(sizes)), pa.py_buffer(np.ascontiguousarray(taken))]
        )
        numbers = self.words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.text, self.start, self.length, self.period = find(numbers, self.first, repeats, least)
        self.runs = np.searchsorted(self.text, np.arange(len(self.first)))

    def collapsed(self) -> list[bytes]:
        """Each text without the words of its runs after their first period, words joined by one blank."""
        begin = self.first[self.text] + self.start
        steps = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(steps, begin + self.period, 1)
        np.add.at(steps, begin + self.length, -1)
        kept = np.cumsum(steps[:-1]) == 0
        at = bounds(kept)[self.first]
        chosen = self.words.filter(pa.array(kept))
        grouped = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), chosen)
        return pc.binary_join(grouped, pa.scalar(b" ", pa.large_binary())).to_pylist()


def _mapped(docs: DataFrame, text: str, new: list[T.StructField], columns, repeats: int, least: int) -> DataFrame:
    """``docs`` with new columns that ``columns`` computes from the words of a block."""
    names = [f.name for f in new]
    kept = [f for f in docs.schema if f.name not in names]

    def run(batches):
        for block in blocks(batches, text):
            own = [block.rows.column(block.rows.schema.get_field_index(f.name)) for f in kept]
            made = columns(_Words(block, repeats, least))
            yield pa.RecordBatch.from_arrays([*own, *made], names=[*[f.name for f in kept], *names])

    return docs.mapInArrow(run, T.StructType([*kept, *new]))


def _listed(found: _Words) -> pa.Array:
    rows = pa.StructArray.from_arrays(
        [pa.array(v, pa.int64()) for v in (found.start, found.length, found.period)], names=["start", "length", "period"]
    )
    return pa.ListArray.from_arrays(pa.array(found.runs, pa.int32()), rows)


def find_runs(docs: DataFrame, text: str = "text", repeats: int = REPEATS, least: int = LEAST_WORDS) -> DataFrame:
    """Every row with the ``runs`` of its text: start (word number from 0), length and period, by start and period."""
    field = T.StructField("runs", T.DataType.fromDDL(RUN))
    return _mapped(docs, text, [field], lambda found: [_listed(found)], repeats, least)


def collapse(docs: DataFrame, text: str = "text", repeats: int = REPEATS, least: int = LEAST_WORDS) -> DataFrame:
    """Every row with its text ``collapsed``: of each run only the first period stays."""
    field = T.StructField("collapsed", T.StringType())

    def columns(found: _Words) -> list[pa.Array]:
        return [pa.array([t.decode("utf-8", "replace") for t in found.collapsed()], pa.string())]

    return _mapped(docs, text, [field], columns, repeats, least)


def _digests(found: _Words) -> list[pa.Array]:
    """Number of runs, the strongest of them, and digests of all and of the collapsed text."""
    strongest, listing = [], []
    ratio = found.length / np.maximum(found.period, 1)
    for a, b in zip(found.runs[:-1], found.runs[1:]):
        rows = zip(found.start[a:b].tolist(), found.length[a:b].tolist(), found.period[a:b].tolist())
        listing.append(hashlib.sha256("".join("%d,%d,%d\n" % r for r in rows).encode()).hexdigest())
        if a == b:
            strongest.append((None, None, None, None))
            continue
        # Close ratios are compared as fractions.
        near = a + np.flatnonzero(ratio[a:b] >= ratio[a:b].max() * (1 - 1e-9))
        best = min(near.tolist(), key=lambda k: (-Fraction(int(found.length[k]), int(found.period[k])), found.start[k], found.period[k]))
        start, length, period = (int(v[best]) for v in (found.start, found.length, found.period))
        strongest.append((start, length, period, 1000 * length // period))
    return [
        pa.array(np.diff(found.runs), pa.int64()),
        *[pa.array([s[k] for s in strongest], pa.int64()) for k in range(4)],
        pa.array(listing, pa.string()),
        pa.array([hashlib.sha256(t).hexdigest() for t in found.collapsed()], pa.string()),
    ]


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """``n_runs``, the run with the greatest ratio of length to period (``start``, ``length``, ``period``, ``exponent_milli``;
    null without runs), ``runs_sha256`` and ``collapsed_sha256`` of every text."""
    longs = ("n_runs", "start", "length", "period", "exponent_milli")
    fields = [T.StructField(n, T.LongType()) for n in longs]
    fields += [T.StructField(n, T.StringType()) for n in ("runs_sha256", "collapsed_sha256")]
    return _mapped(docs, text, fields, _digests, REPEATS, LEAST_WORDS)


def with_planted(docs: DataFrame) -> DataFrame:
    """Documents with their words joined by blanks; one in ten by the crc32 of its id repeats a stretch up to its end.

    With h that checksum and g = h // 10, the words from a = g % n on repeat with the period 1 + (n - a) // (3 + g % 8).
    """
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), SPLIT), "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    parts = docs.select("doc_id", words.alias("_w"), h.alias("_h"), F.floor(h / 10).alias("_g"))
    n = F.size("_w").cast("long")
    # One element is exploded, so that words are split once.
    parts = parts.select("doc_id", "_w", F.inline(F.array(F.struct("_h", "_g", n.alias("_n")))))
    a = F.when(F.col("_n") > 0, F.col("_g") % F.nullif("_n", F.lit(0)))
    p = F.floor((F.col("_n") - a) / (F.col("_g") % 8 + 3)) + 1

    def word(w: Column, i: Column) -> Column:
        return F.when(i < F.col("_a"), w).otherwise(F.get("_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))

    parts = parts.select("doc_id", "_w", "_h", "_n", F.inline(F.array(F.struct(a.alias("_a"), p.alias("_p")))))
    planted = F.when((F.col("_h") % 10 == 0) & (F.col("_n") > 0), F.transform("_w", word)).otherwise(F.col("_w"))
    return parts.select("doc_id", F.array_join(planted, " ").alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """Digests of the runs of every document, with the planted repetitions."""
    return digests(with_planted(docs)).drop("text")
