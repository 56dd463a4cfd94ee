"""Cloud events and metric series, alone and around failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.operators import ordered


def pod_events(
    events: DataFrame, pod_name: str, extra: str | None = None, limit: int = 20
) -> DataFrame:
    """The newest container events of one pod; ``extra`` is a SQL condition."""
    rows = events.where((F.col("resource_type") == "k8s_container") & (F.col("pod_name") == pod_name))
    if extra:
        rows = rows.where(extra)
    return rows.orderBy(F.desc("ts"), F.desc("insert_id")).limit(limit)


def pod_events_each(events: DataFrame, extra: str | None = None, limit: int = 20) -> DataFrame:
    """``pod_events`` of every pod at once. The rank limit runs before the shuffle."""
    rows = events.where("resource_type = 'k8s_container' AND pod_name IS NOT NULL")
    if extra:
        rows = rows.where(extra)
    newest = Window.partitionBy("cluster", "pod_name").orderBy(F.desc("ts"), F.desc("insert_id"))
    return rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)


def attach_telemetry(
    incidents: DataFrame,
    events: DataFrame,
    key: str = "run_id",
    window_seconds: int = 600,
) -> DataFrame:
    """Add what the cluster's events say around each failure: ``n_events``,
    ``n_errors``, ``n_critical`` and the pivotal event, which is the first critical
    one, else the last of any severity."""
    summary = ordered.around(
        incidents,
        events,
        ["cluster"],
        key,
        "ts",
        "ts",
        "insert_id",
        window_seconds,
        window_seconds,
        {
            "n_events": F.lit(True),
            "n_errors": F.col("severity").isin("ERROR", "CRITICAL"),
            "n_critical": F.col("severity") == "CRITICAL",
        },
        F.col("severity") == "CRITICAL",
        ["severity"],
    )
    pivot = F.coalesce("first", "last")
    return incidents.join(
        summary.select(
            key,
            "n_events",
            "n_errors",
            "n_critical",
            pivot["insert_id"].alias("pivotal_id"),
            pivot["severity"].alias("pivotal_severity"),
        ),
        key,
        "left",
    )


def metric_pick(metrics: DataFrame, name: str) -> DataFrame:
    """Series of each cluster whose metric name contains ``name``; a cluster
    without one answers with its first metric by name."""
    per_cluster = metrics.groupBy("cluster").agg(
        F.min(
            F.struct((~F.contains("metric", F.lit(name))).alias("miss"), F.col("metric"))
        ).alias("best")
    )
    # One row per cluster, null among them, joins by equality with its samples.
    choice = per_cluster.select(F.col("cluster").alias("_of"), F.col("best.metric").alias("_metric"))
    return metrics.join(
        choice, F.col("cluster").eqNullSafe(F.col("_of")) & (F.col("metric") == F.col("_metric")), "left_semi"
    )


def metric_at_failure(
    incidents: DataFrame,
    metrics: DataFrame,
    metric: str,
    keys: tuple[str, ...] = ("cluster", "pod_name"),
) -> DataFrame:
    """The last sample of ``metric`` at or before each failure."""
    samples = metrics.where(F.col("metric") == metric).select(
        *keys, F.col("ts").alias("sample_ts"), F.col("value").alias("sample_value")
    )
    return ordered.asof_join(
        incidents, samples, list(keys), "ts", "sample_ts", ["sample_ts", "sample_value"],
        tie="sample_value",
    )


def upstream_cause(
    sensor_failures: DataFrame,
    dependencies: DataFrame,
    runs: DataFrame,
) -> DataFrame:
    """Failed upstream run behind each sensor failure.

    ``dependencies`` maps ``dag_id`` to ``upstream_cluster``, ``upstream_dag_id``.
    The upstream run looked at is the last one at or before the failure; failures
    whose upstream run did not fail drop out.
    """
    waiting = sensor_failures.join(dependencies, "dag_id")
    upstream = runs.select(
        F.col("cluster").alias("upstream_cluster"),
        F.col("dag_id").alias("upstream_dag_id"),
        F.col("ts").alias("_uts"),
        F.col("run_id").alias("upstream_run_id"),
        F.col("state").alias("upstream_state"),
    )
    return ordered.asof_join(
        waiting, upstream, ["upstream_cluster", "upstream_dag_id"], "ts", "_uts",
        ["upstream_run_id", "upstream_state"], tie="upstream_run_id",
    ).where("upstream_state = 'failed'")


def partition_calendar(spans: DataFrame, keys: list[str], first: str, until: str, step: str = "1 hour") -> DataFrame:
    """(keys, ``part``): the partitions due from ``first`` to ``until``, every ``step``.

    Partitions count from ``first``, so a daily calendar that starts at 06:00 expects 06:00.
    """
    due = F.explode(F.expr(f"sequence({first}, {until}, interval {step})"))
    return spans.where(f"{first} <= {until}").select(*keys, due.alias("part"))


def missing_partitions(expected: DataFrame, present: DataFrame, keys: list[str], at: str = "part") -> DataFrame:
    """Expected partitions (keys, ``part``) that were never written, and by how many
    seconds each lies after the last one written before it (null if there is none).

    A row of ``present`` fills the latest partition due at or before its time ``at``,
    so partitions need no fixed length, and the one a sensor waits for now is reported
    even though nothing was written after it.
    """
    due = expected.select(*keys, "part").distinct()
    filled = (
        ordered.asof_join(present.select(*keys, F.col(at).alias("_at")), due, keys, "_at", "part", ["part"])
        .where("part IS NOT NULL").select(*keys, "part").distinct()
    )
    missing = due.join(filled, [*keys, "part"], "left_anti")
    written = filled.select(*keys, F.col("part").alias("_written"))
    found = ordered.asof_join(missing, written, keys, "part", "_written", ["_written"])
    return found.select(*keys, "part", (F.unix_seconds("part") - F.unix_seconds("_written")).alias("lag_seconds"))


WAIT_TEXT = r"Process (\d+) waits for \w+; blocked by process (\d+)"


def wait_edges(logs: DataFrame, carry: list[str], column: str = "log_text") -> DataFrame:
    """(process, blocked_by) edges stated in log texts."""
    hit = F.regexp_extract_all(column, F.lit(WAIT_TEXT), F.lit(0))
    return logs.select(*carry, F.explode(hit).alias("_hit")).select(
        *carry,
        F.regexp_extract("_hit", WAIT_TEXT, 1).cast("long").alias("process_id"),
        F.regexp_extract("_hit", WAIT_TEXT, 2).cast("long").alias("blocked_by"),
    )


def deadlock_pairs(edges: DataFrame, scope: list[str]) -> DataFrame:
    """Processes that wait for each other within the same scope.

    Both directions of a pair share one group, so counting replaces a self-join.
    """
    low, high = F.least("process_id", "blocked_by"), F.greatest("process_id", "blocked_by")
    return (
        edges.where("process_id <> blocked_by")
        .groupBy(*scope, low.alias("process_a"), high.alias("process_b"))
        .agg(
            F.count_if(F.col("process_id") < F.col("blocked_by")).alias("a_waits"),
            F.count_if(F.col("process_id") > F.col("blocked_by")).alias("b_waits"),
        )
        .where("a_waits > 0 AND b_waits > 0")
    )


def usage_against_limit(metrics: DataFrame, usage: str, limit: str, keys: list[str]) -> DataFrame:
    """Usage samples with the limit sample of the same instant, in one grouping."""
    return (
        metrics.where(F.col("metric").isin(usage, limit))
        .groupBy(*keys, "ts")
        .agg(
            F.max(F.when(F.col("metric") == usage, F.col("value"))).alias("used"),
            F.max(F.when(F.col("metric") == limit, F.col("value"))).alias("allowed"),
        )
        .where("used IS NOT NULL AND allowed IS NOT NULL")
    )


def metric_saturation(
    paired: DataFrame, keys: list[str], threshold: float = 0.9
) -> DataFrame:
    """Peak, mean, last usage, peak share of the limit and seconds spent above
    ``threshold`` of it, per key. A sample holds until the next one."""
    timed = ordered.neighbour(
        paired, keys, "ts", "used", {"_next": "ts"}, forward=True
    )
    held = ordered.epoch_us("_next") - ordered.epoch_us("ts")
    above = F.col("used") > F.col("allowed") * threshold
    return timed.groupBy(*keys).agg(
        F.max("used").alias("peak"),
        F.avg("used").alias("mean"),
        F.max_by("used", "ts").alias("last"),
        F.max(F.col("used") / F.nullif("allowed", F.lit(0.0))).alias("peak_share"),
        (F.sum(F.when(above & F.col("_next").isNotNull(), held).otherwise(0)) / 1e6).alias(
            "seconds_above"
        ),
    )


def spike_recovery(
    metrics: DataFrame, keys: list[str], tie: str = "value"
) -> DataFrame:
    """Whether a series spiked and came back to zero, and how long the last spike
    took to clear: from its last sample to the one after it."""
    timed = ordered.neighbour(
        metrics, keys, "ts", tie, {"_next": "ts"}, forward=True
    )
    high_at = F.when(F.col("value") != 0, ordered.epoch_us("ts"))
    wait = ordered.epoch_us("_next") - ordered.epoch_us("ts")
    return (
        timed.groupBy(*keys)
        .agg(
            F.max("value").alias("peak"),
            F.max_by("value", "ts").alias("last"),
            F.max_by(wait, high_at).alias("_wait"),
        )
        .select(
            *keys,
            "peak",
            "last",
            ((F.col("peak") > 0) & (F.col("last") == 0)).alias("is_transient"),
            (F.col("_wait") / 1e6).alias("recovery_seconds"),
        )
    )


def memory_trend(paired: DataFrame, keys: list[str], origin: Column) -> DataFrame:
    """Slope of usage in units per hour and hours until the limit is reached.

    Time counts from ``origin``, which keeps the sums small.
    """
    hours = (ordered.epoch_us("ts") - ordered.epoch_us(origin)) / 3.6e9
    fitted = paired.groupBy(*keys).agg(
        F.regr_slope("used", hours).alias("slope_per_hour"),
        F.max_by("used", "ts").alias("last"),
        F.max_by("allowed", "ts").alias("allowed"),
    )
    left = F.col("allowed") - F.col("last")
    return fitted.withColumn(
        "hours_to_limit", F.when(F.col("slope_per_hour") > 0, left / F.col("slope_per_hour"))
    )


def concurrency_peak(
    spans: DataFrame, keys: list[str], start: str, end: str, limit: int
) -> DataFrame:
    """Most tasks running at once per key, against the connection limit."""
    steps = spans.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col(start).alias("ts"), F.lit(1).alias("delta")),
                F.struct(F.col(end).alias("ts"), F.lit(-1).alias("delta")),
            )
        ).alias("_s"),
    ).select(*keys, "_s.*")
    peak = ordered.running_peak(steps, keys, "ts", "delta")
    return peak.withColumn("over_limit", F.col("peak") > limit)


def incident_timeline(
    records: DataFrame,
    events: DataFrame,
    metrics: DataFrame,
    where: str | Column | None = None,
) -> DataFrame:
    """Log records, cloud events and metric samples per cluster in time order, with
    the gap to the entry before. ``where`` narrows it to one incident.

    Each input has ``cluster``, ``ts`` and a unique ``ref``; the result is sorted.
    """
    parts = [
        records.select("cluster", "ts", F.lit("log").alias("kind"), "ref", F.col("level").alias("detail")),
        events.select("cluster", "ts", F.lit("event").alias("kind"), "ref", F.col("severity").alias("detail")),
        metrics.select("cluster", "ts", F.lit("metric").alias("kind"), "ref", F.col("metric").alias("detail")),
    ]
    if where is not None:
        parts = [part.where(where) for part in parts]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rows = rows.withColumn("_tie", F.concat_ws("/", "kind", "ref"))
    timed = ordered.neighbour(
        rows, ["cluster"], "ts", "_tie", {"_before": "ts"}
    )
    gap = (ordered.epoch_us("ts") - ordered.epoch_us("_before")) / 1e6
    return (
        timed.withColumn("gap_seconds", gap).drop("_before").orderBy("cluster", "ts", "_tie").drop("_tie")
    )
