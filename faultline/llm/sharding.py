"""Stable shards by weighted rendezvous hashing, without Python.

Every shard draws a number for the key of a row, from the digest of the key and the number of
the shard, and the shard with the largest weighted draw takes the row: ``weight / -ln(u)``
with ``u`` even between 0 and 1 gives each shard rows in proportion to its weight. The
draws of the other shards do not change when one is added, so rows move only into the new
one, a share of its weight over all weights. Key and shards alone decide; digests are MD5 in
hexadecimal, which any language can repeat.

``number_rows`` gives rows their places in a shard, without gaps, in order of the digest of
the key. No task sees a whole shard: places are sums over buckets of digests, over the
distinct rows of a bucket, and over salted parts of equal rows, however many these are.

Equal keys share a shard. A null key counts as the empty text and shares its shard. Rows equal
in key and order columns are interchangeable: which has which of their places is open, the table is
the same. Empty tables give empty tables. Other columns are kept by ``place``
and ``write_shards``; columns named as the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.shared import written

# Hexadecimal digits of a draw, which a double holds exactly, and of a bucket of keys.
DRAW_DIGITS = 13
BUCKET_DIGITS = 3
# Parts into which equal rows are cut.
SALTS = 1024


def _key(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def draws(key: Column, weights: Sequence[float]) -> Column:
    """The weighted draw of each shard for a key: an array of (``score``, ``nth``).

    ``nth`` falls as the number of the shard rises, so of equal scores the first shard has the largest entry.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    shards = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(float(w)).alias("w")) for s, w in enumerate(weights)])
    own = _key(key)

    def draw(shard: Column) -> Column:
        digest = F.md5(F.concat(own, F.lit(":"), shard["s"].cast("string")).cast("binary"))
        whole = F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("double")
        even = (whole + 0.5) / float(16**DRAW_DIGITS)
        return F.struct((shard["w"] / -F.ln(even)).alias("score"), (-shard["s"]).alias("nth"))

    return F.transform(shards, draw)


def place(rows: DataFrame, key: str, weights: Sequence[float], added: float | None = None) -> DataFrame:
    """Every row with its ``shard``; with ``added``, also its ``grown_shard`` once a shard of that weight joins."""
    count = len(weights)
    drawn = draws(F.col(key), [*weights] if added is None else [*weights, added])
    picked = rows.withColumn("_draws", drawn).withColumn("_best", F.array_max(F.slice("_draws", 1, count)))
    out = {"shard": -F.col("_best.nth")}
    if added is not None:
        newest = F.get("_draws", F.lit(count))
        out["grown_shard"] = F.when(newest["score"] > F.col("_best.score"), count).otherwise(-F.col("_best.nth"))
    return picked.withColumns(out).drop("_draws", "_best")


def number_rows(rows: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``place`` with their ``slot`` in the shard, from 0, without gaps.

    Order is that of the digest of the key, of the key, and of the columns ``order``. Pass narrow rows:
    they are written once, so that salts stay as they are, and shuffled.
    """
    ties = [f"_tie{k}" for k in range(len(order))]
    mark = F.struct(*[F.col(c) for c in order]) if order else F.lit(0)
    salted = rows.withColumns(
        {
            "_key": _key(F.col(key)),
            "_mark": F.to_json(F.struct(*[F.col(c).alias(t) for c, t in zip(order, ties)])) if order else F.lit(""),
            "_salt": F.monotonically_increasing_id() % SALTS,
        }
    )
    salted = written(salted, "shard-rows")
    digest = F.md5(F.col("_key").cast("binary"))
    # Equal rows become one row per salt before anything is sorted.
    sorts = [F.col(c) for c in order]
    parts = (
        salted.groupBy("shard", "_key", "_mark", "_salt")
        .agg(F.count("*").alias("_rows"), F.first(mark).alias("_order"))
        .withColumns({"_digest": digest, "_bucket": F.substring(digest, 1, BUCKET_DIGITS)})
    )
    buckets = parts.groupBy("shard", "_bucket").agg(F.sum("_rows").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_size")
    buckets = buckets.select("shard", "_bucket", before.alias("_before"))
    within = Window.partitionBy("shard", "_bucket").orderBy("_digest", "_key", "_order", "_mark", "_salt")
    running = F.sum("_rows").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_rows")
    starts = (
        parts.withColumn("_inside", running)
        .join(buckets, ["shard", "_bucket"])
        .select("_key", "_mark", "_salt", (F.col("_before") + F.col("_inside")).alias("_start"))
    )
    own = ["_key", "_mark", "_salt"]
    nth = F.row_number().over(Window.partitionBy(*own).orderBy(*sorts, "_salt")) - 1
    placed = salted.withColumn("_nth", nth).join(starts, own)
    return placed.withColumn("slot", F.col("_start") + F.col("_nth")).drop(*own, "_nth", "_start")


def write_shards(rows: DataFrame, folder: str) -> None:
    """Write rows of ``place`` to one folder per shard.

    Rows meet by shard, and a shard larger than a task should hold is split over several files.
    """
    rows.hint("rebalance", "shard").write.partitionBy("shard").mode("overwrite").parquet(folder)


def report(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard, slot and shard after growth by one, of every document, with equal weights."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    narrow = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = place(narrow, "doc_id", [1.0] * shards, added=1.0)
    return number_rows(placed, "doc_id", ["size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
