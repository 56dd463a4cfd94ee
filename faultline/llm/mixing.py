"""Mixing of sources to target weights by balanced sampling with the cube method.

Sources in code point order, null last, have weights 5, 2, 1, repeating, and share all words by
weight. A target stops at three times the size of its source and the excess is
shared by weight among the others. A source that needs r times its words takes every document
floor(r) times, and once more those of a sample with inclusion probability r - floor(r).

The sample is drawn by the cube method. In a flight three documents at a time move along
the null space of two constraints, the number of documents and of words, until one of
them is taken or left for good, so both totals stay what they were. Flights run in
buckets of a few thousand documents of one source. The two or fewer documents a bucket
leaves undecided fly again in the buckets of the next round, until one bucket per
source remains, whose last documents land on the side closest to the total of words.

Rows with equal id, source and text are one unit and share its decision. All
choices are seeded by hashes, so reruns agree. A null text has no words. A document without words is
sampled like others of its source and counts no words. A source without words has target 0 and takes nothing.
Other columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.shared import discard, word_count, written

# Weights of sources in their order, repeating, and the most repeats (fixed values).
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BUCKET_UNITS = 4096
_SURE = 1e-9


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source."""
    ordered = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(ordered) - 1) % len(WEIGHTS) + 1))
    rows = sizes.withColumn("weight", weight.cast("double"))
    # Sources reach their limit in the order of limit by weight. The level is what one unit of
    # weight gets once those before it have reached theirs.
    limit = MOST_REPEATS * F.col("source_size")
    by_limit = Window.orderBy(limit / F.col("weight"), F.asc_nulls_last("source"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))) / F.sum("weight").over(from_here)
    leveled = rows.withColumn("level", level).withColumn("fits", F.col("level") <= limit / F.col("weight"))
    # The smallest level that fits is the first one.
    common = F.coalesce(F.min(F.when(F.col("fits"), F.struct(limit / F.col("weight"), "level"))).over(everything)["level"], F.lit(0.0))
    return leveled.withColumn("target", F.least(limit.cast("double"), common * F.col("weight"))).select(
        "source", "source_size", "target"
    )


def flight(chance: np.ndarray, constraints: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities to 0 or 1 in the null space of the constraints.

    ``constraints`` has one row per unit and two columns. At most two units stay undecided.
    """
    # Chances that rounding alone keeps from 0 or 1 are decided, so that no unit is left open for ever.
    chance = np.where(chance <= _SURE, 0.0, np.where(chance >= 1 - _SURE, 1.0, chance))
    spins = iter(rng.random(len(chance) + 1))
    held: list[int] = []
    for unit in np.flatnonzero((chance > 0) & (chance < 1)).tolist():
        held.append(unit)
        if len(held) < 3:
            continue
        (a, x), (b, y), (c, z) = constraints[held].tolist()
        move = [b * z - c * y, c * x - a * z, a * y - b * x]
        size = max(map(abs, move))
        if size <= _SURE * max(1.0, abs(x), abs(y), abs(z)):
            # Only one constraint is left: two units change places.
            move = [y, -x, 0.0] if x or y else [b, -a, 0.0]
            size = max(map(abs, move))
        p = chance[held].tolist()
        move = [m / size for m in move]
        up = min((1 - q) / m if m > 0 else -q / m for q, m in zip(p, move, strict=True) if m)
        down = min(q / m if m > 0 else -(1 - q) / m for q, m in zip(p, move, strict=True) if m)
        step = up if next(spins) * (up + down) < down else -down
        for k, q, m in zip(held, p, move, strict=True):
            q += step * m
            chance[k] = 0.0 if q < _SURE else 1.0 if q > 1 - _SURE else q
        held = [k for k in held if 0 < chance[k] < 1]
    return chance


def landing(chance: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Decide the last units so that the sum of words is closest to what is expected."""
    rest = np.flatnonzero((chance > 0) & (chance < 1))
    out, wanted = np.round(chance), float(chance[rest] @ words[rest])
    out[rest] = min(
        itertools.product((0.0, 1.0), repeat=len(rest)),
        key=lambda pick: (abs(sum(p * w for p, w in zip(pick, words[rest], strict=True)) - wanted), pick),
        default=(),
    )
    return out


def _fly(units: DataFrame, counts: DataFrame, level: int) -> DataFrame:
    """One round of flights in buckets, with the landing in sources that are one bucket."""

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values(["place", "doc_id", "key"], ignore_index=True)
        words = (bucket["rows"] * bucket["size"]).to_numpy(float)
        sides = np.stack([bucket["rows"].to_numpy(float), words], axis=1)
        seed = [level, len(bucket), int(bucket["place"].iloc[0]) & (2**63 - 1)]
        chance = flight(bucket["chance"].to_numpy(), sides, np.random.default_rng(seed))
        if bucket["buckets"].iloc[0] == 1:
            chance = landing(chance, words)
        return bucket.assign(chance=chance)[list(names)]

    names = units.columns
    dealt = (
        units.join(counts.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        .withColumn("place", F.xxhash64(F.lit(level), "doc_id", "key"))
        .withColumn("bucket", F.expr("pmod(xxhash64(place), buckets)"))
    )
    return dealt.groupBy("source", "bucket").applyInPandas(run, units.schema)


def decisions(docs: DataFrame) -> DataFrame:
    """Copies per unit: doc_id, source, key (hash of the text), rows, size, source_size, target, copies."""
    units = written(
        docs.select("doc_id", "source", F.xxhash64("text").alias("key"), word_count().alias("size"))
        .groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("rows")),
        "units",
    )
    sizes = units.groupBy("source").agg(F.sum(F.col("rows") * F.col("size")).alias("source_size"))
    goals = written(targets(sizes).withColumn("ratio", F.expr(
        f"if(source_size > 0, least(target / source_size, {MOST_REPEATS}D), 0D)")), "targets")
    of = goals.withColumnRenamed("source", "of")
    planned = (
        units.join(of, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        .withColumn("whole", F.floor("ratio").cast("int")).withColumn("chance", F.col("ratio") - F.floor("ratio"))
        .drop("ratio")
    )
    done: DataFrame | None = None
    open_, level = planned, 0
    while True:
        counts = open_.groupBy("source").agg(F.expr(f"1 + (count(*) - 1) div {BUCKET_UNITS}").alias("buckets"))
        counts = written(counts, "counts")
        last = (counts.agg(F.max("buckets")).first()[0] or 1) == 1
        flown = written(_fly(open_, counts, level), f"flight{level}")
        sure = flown if last else flown.where("chance IN (0, 1)")
        done = sure if done is None else done.unionByName(sure)
        if last:
            break
        open_, level = flown.where("chance NOT IN (0, 1)"), level + 1
    discard(units)
    return done.withColumn("copies", (F.col("whole") + F.col("chance")).cast("int")).drop("whole", "chance")


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    columns = {"doc_id": "__mix_id", "source": "__mix_source", "key": "__mix_key", "copies": "__mix_copies"}
    chosen = decisions(docs).where("copies > 0").select(*[F.col(c).alias(n) for c, n in columns.items()])
    same = (
        docs["doc_id"].eqNullSafe(F.col("__mix_id")) & docs["source"].eqNullSafe(F.col("__mix_source"))
        & (F.xxhash64(docs["text"]) == F.col("__mix_key"))
    )
    names = [f"`{n}`" for n in docs.columns]
    taken = docs.join(chosen, same)
    return taken.withColumn("__mix_copy", F.explode(F.expr("sequence(1, __mix_copies)"))).select(*names)


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source) and taken words."""
    units = decisions(docs)
    return units.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        "copies", F.explode(F.expr("sequence(1, rows)")).alias("_row"),
    ).drop("_row")
