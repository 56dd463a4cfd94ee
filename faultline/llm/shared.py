"""Helpers of several operators: whole texts as byte arrays, words, hashes, scratch tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import scratch_dir

# A word is a run of characters other than these separators.
SEPARATORS = b" \t\n\x0b\x0c\r"
SPLIT = "[\\x20\\x09-\\x0D]+"
# Bytes of text handled at once in one task; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_FACTOR, _INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte slices [start, end), equal for equal slices."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class Block:
    """Some whole texts of a batch: their bytes end to end and where each begins."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and the number of the first word of each text."""
        data, n = self.data, len(self.data)
        inside = ~_SPACE[data]
        border = np.zeros(n + 1, bool)
        border[self.offsets] = True
        begin, finish = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | border[1:n]
        finish[:-1] &= ~inside[1:] | border[1:n]
        starts = np.flatnonzero(begin)
        return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, self.offsets)

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def blocks(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES, rows: int | None = None
) -> Iterator[Block]:
    """Cut batches into blocks of about ``limit`` bytes of whole texts, and at most ``rows`` of them. Null counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, ends, raw = texts.buffers()
        offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            to = min(to, len(texts), at + rows if rows else len(texts))
            yield Block(
                batch.slice(at, to - at),
                data[offsets[at] : offsets[to]],
                offsets[at : to + 1] - offsets[at],
            )
            at = to


def runs(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every ``width`` neighbouring values within one text.

    Also the position of each in ``hashes`` and, for each text, the number of its
    first run.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(first), np.int64)
    total = np.zeros(n, np.uint64)
    factor = 1
    for k in range(width):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        total += hashes[k : k + n] * np.uint64(factor)
    whole = np.ones(n, bool)
    for k in range(1, width):
        # A run that starts k words before the end of a text crosses its border.
        late = first[1:-1] - k
        whole[late[(late >= 0) & (late < n)]] = False
    at = np.flatnonzero(whole)
    return mix(total[at]), at, np.searchsorted(at, first)


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the long values Spark has."""
    return np.ascontiguousarray(values).view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """One list per row from values end to end."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def bounds(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of slices given by start and length, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that all executors share; ``faultline.session.clear_scratch`` removes it."""
    return scratch_dir(spark, f"corpus/{purpose}")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a written table in the shared folder: computed once, safe from lost executors.

    The shuffle files behind the table are removed as soon as it is written.
    """
    spark = df.sparkSession
    path = scratch(spark, purpose)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: str = "text") -> "F.Column":
    """Number of words of a text, 0 for null, without leaving the JVM."""
    return F.coalesce(
        F.size(F.array_remove(F.split(F.col(text), SPLIT), "")), F.lit(0)
    ).cast("long")
