"""Walks over graphs of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.session import remove, scratch_dir


def walk(start: DataFrame, edges: DataFrame, come: str, go: str, kind: str) -> DataFrame:
    """Pairs (``a``, ``b``) reached from ``start`` over edges from ``come`` to ``go``, with the least ``depth``.

    Each round extends only the pairs found in the round before and writes its new
    pairs to the shared scratch folder, so a lost executor costs one round. It ends
    when a round finds nothing new, so cycles end by themselves.
    """
    spark = edges.sparkSession
    root = scratch_dir(spark, "walk")
    step = edges.select(F.col(come).alias("b"), F.col(go).alias("_next")).distinct()
    step.write.parquet(f"{root}/edges")
    step = spark.read.schema(step.schema).parquet(f"{root}/edges")
    fresh, depth = start, 1
    while True:
        path = f"{root}/pairs/depth={depth}"
        fresh.write.parquet(path)
        found = spark.read.schema(f"a {kind}, b {kind}").parquet(path)
        known = spark.read.schema(f"a {kind}, b {kind}, depth int").parquet(f"{root}/pairs")
        if found.isEmpty():
            remove(spark, f"{root}/edges")
            return known
        onward = found.join(step, "b").select("a", F.col("_next").alias("b")).distinct()
        fresh, depth = onward.join(known, ["a", "b"], "left_anti"), depth + 1


def closure(edges: DataFrame, come: str, go: str, kind: str) -> DataFrame:
    """All pairs (``a``, ``b``) joined by a path of edges from ``come`` to ``go``, with the least ``depth``.

    Every round doubles the length of the paths: a path of up to twice the length has a place at exactly that length, so only the
    pairs that far apart are joined with all pairs found. Rounds are written, as in ``walk``; there are
    as many as the longest path has binary digits.
    """
    spark = edges.sparkSession
    root = scratch_dir(spark, "closure")
    fresh = edges.select(F.col(come).alias("a"), F.col(go).alias("b")).distinct().withColumn("depth", F.lit(1))
    reach = 1
    while True:
        path = f"{root}/reach={reach}"
        fresh.write.parquet(path)
        known = spark.read.schema(f"a {kind}, b {kind}, depth int").parquet(root).select("a", "b", "depth")
        if spark.read.schema(known.schema).parquet(path).isEmpty():
            return known
        far = known.where(F.col("depth") == reach).select("a", F.col("b").alias("_by"))
        onward = known.select(F.col("a").alias("_by"), "b", "depth")
        longer = far.join(onward, "_by").groupBy("a", "b").agg((F.min("depth") + reach).alias("depth"))
        fresh, reach = longer.join(known.select("a", "b"), ["a", "b"], "left_anti"), 2 * reach
