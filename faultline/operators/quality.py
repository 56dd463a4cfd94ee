"""Data checks: duplicates, declared tests, baselines and volume contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from faultline.operators import ordered


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("count")).where("count > 1")


def column_tests(rows: DataFrame, unique: list[str] = (), not_null: list[str] = ()) -> DataFrame:
    """Declared column tests: ``test``, ``column``, ``failures``, ``status``.

    ``unique`` counts values that occur more than once, ``not_null`` counts null
    rows. All ``not_null`` tests share one pass; each ``unique`` test groups its
    own column.
    """
    parts = []
    if not_null:
        counted = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in not_null])
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("failures")) for c in not_null])
        parts.append(
            counted.select(F.explode(pairs).alias("_p")).select(F.lit("not_null").alias("test"), "_p.*")
        )
    for column in unique:
        repeated = duplicate_keys(rows.where(F.col(column).isNotNull()), [column])
        parts.append(
            repeated.agg(F.count("*").alias("failures")).select(
                F.lit("unique").alias("test"), F.lit(column).alias("column"), "failures"
            )
        )
    return reduce(DataFrame.unionByName, parts).withColumn(
        "status", F.when(F.col("failures") > 0, "fail").otherwise("pass")
    )


def success_baseline(
    runs: DataFrame, keys: list[str], ts: str, tie: str, value: str, n: int = 5, **sizing: int
) -> DataFrame:
    """Mean, deviation and last value of the ``n`` successful runs before each run of
    the same task, and how far off the run itself is.

    Every run is judged, failed ones above all; only successful ones are history.
    """
    rows = ordered.preceding_where(
        runs, F.col("state") == "success", keys, ts, tie, n,
        {
            "base_n": F.count(value),
            "base_mean": F.avg(value),
            "base_std": F.stddev_samp(value),
            "base_last": F.last(value),
        },
        **sizing,
    ).withColumn("base_n", F.coalesce("base_n", F.lit(0)))
    return rows.withColumn(
        "z_score", (F.col(value) - F.col("base_mean")) / F.nullif("base_std", F.lit(0.0))
    )


def volume_contract(
    deliveries: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    rows_column: str = "rows",
    n: int = 5,
    k: float = 2.0,
    tolerance: float | None = None,
    least: int = 3,
    accepted: str | None = None,
    **sizing: int,
) -> DataFrame:
    """Judge each delivery against the last ``n`` accepted ones before it.

    Empty deliveries are ``ZERO_ROWS``; others are ``OUT_OF_RANGE`` when they miss
    the mean by more than ``tolerance`` rows, or without one by more than ``k``
    deviations. With fewer than ``least`` accepted deliveries before it, a delivery is
    only judged for being empty. ``accepted`` is a SQL condition on what the consumer
    took in; without one every delivery with rows counts.
    """
    taken = F.expr(accepted) if accepted else F.col(rows_column) > 0
    rows = ordered.preceding_where(
        deliveries, taken, keys, ts, tie, n,
        {"base_n": F.count(rows_column), "base_mean": F.avg(rows_column), "base_std": F.stddev_samp(rows_column)},
        **sizing,
    )
    allowed = F.lit(tolerance) if tolerance is not None else F.col("base_std") * k
    off = (F.col("base_n") >= least) & (F.abs(F.col(rows_column) - F.col("base_mean")) > allowed)
    return rows.withColumn(
        "verdict",
        F.when(F.col(rows_column) == 0, "ZERO_ROWS").when(off, "OUT_OF_RANGE").otherwise("OK"),
    )


def dbt_run_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Status counts, total and longest execute time and error codes per run.

    ``results`` has ``status``, ``timing`` (array of name and duration) and
    ``code``. Codes come from a short fixed vocabulary.
    """
    execute = F.aggregate(
        F.filter("timing", lambda x: x["name"] == "execute"),
        F.lit(0.0),
        lambda total, x: total + x["duration"],
    )
    return (
        results.withColumn("_s", execute)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n_results"),
            F.count_if(F.col("status") == "success").alias("n_success"),
            F.count_if(F.col("status") == "error").alias("n_error"),
            F.sum(F.col("_s").cast("decimal(20,6)")).cast("double").alias("execute_seconds"),
            F.max("_s").alias("longest_seconds"),
            F.array_join(F.sort_array(F.collect_set("code")), ",").alias("error_codes"),
        )
    )


def failing_file(results: DataFrame, column: str = "message") -> DataFrame:
    """Add ``failing_file``: the model path a result message names, else null."""
    path = F.regexp_extract(column, r"\((models/[^)]+\.sql)\)", 1)
    return results.withColumn("failing_file", F.nullif(path, F.lit("")))
