"""Streaming queries: tables are written as files, read as a stream, and drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.plans import alerts, telemetry  # noqa: F401  (derived relations)
from faultline.plans import derived
from faultline.plans.registry import query
from faultline.plans.telemetry import FORMAT, USED
from faultline.plans.triage import pairs, routed
from faultline.session import ROCKSDB_PROVIDER, scratch_dir
from faultline.sources import lake
from faultline.streaming import alerts as ops

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stream_of(rows: DataFrame) -> DataFrame:
    """Write rows as files and open them as a stream."""
    path = scratch_dir(rows.sparkSession, "stream-in")
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


def drained(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    spark.conf.set(PROVIDER, ROCKSDB_PROVIDER)
    return ops.drain(stream, scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-state"))


def alert_rows(t) -> DataFrame:
    return t.failed_runs.select(
        F.col("run_id").alias("alert_id"), "cluster", "dag_id", "task_id", "run_id", F.col("attempt").alias("try_number"),
        "execution_date", F.col("ts").cast("timestamp").alias("received_at"),
    )


@query(
    "stream_alerts",
    """SELECT cluster, dag_id, count(*) AS n_alerts, max(attempt) AS last_try FROM {failed_runs} GROUP BY ALL""",
)
def _(t):
    path = scratch_dir(t.spark, "alerts")
    rows = alert_rows(t).withColumns({"event_type": F.lit("AIRFLOW_TASK_FAILED"), "prompt": F.lit("")})
    rows.drop("alert_id").write.json(path)
    got = drained(lake.stream_alerts(t.spark, path, max_files=2))
    return got.groupBy("cluster", "dag_id").agg(F.count("*").alias("n_alerts"), F.max("try_number").alias("last_try"))


@query(
    "stream_decisions",
    """SELECT run_id, failure_category, can_auto_remediate, remediation_action, parameters, route FROM {routed}""",
)
def _(t):
    return drained(ops.decide(stream_of(t.failed_runs))).select(
        "run_id", "failure_category", "can_auto_remediate", "remediation_action",
        pairs("action_parameters").alias("parameters"), "route",
    )


@query(
    "stream_dedup",
    """SELECT DISTINCT cluster, dag_id, task_id, execution_date, attempt AS try_number FROM {failed_runs}""",
)
def _(t):
    keys = ["cluster", "dag_id", "task_id", "execution_date", "try_number"]
    return drained(ops.deduplicate(stream_of(alert_rows(t)), within="1 hour", keys=keys)).select(*keys)


@query(
    "stream_retry_budget",
    """SELECT run_id AS alert_id, cast(retry AS int) AS retry, retry <= 2 AS allowed FROM (
         SELECT run_id, row_number() OVER (PARTITION BY cluster, dag_id, task_id, execution_date ORDER BY ts, run_id) AS retry
         FROM {failed_runs}) r""",
)
def _(t):
    keys = ["cluster", "dag_id", "task_id", "execution_date"]
    return drained(ops.retry_budget(stream_of(alert_rows(t)), keys=keys))


@query(
    "stream_saturation",
    f"""WITH s AS (SELECT * FROM {{metrics}} WHERE metric = '{USED}'),
          w AS (SELECT cluster, pod_name, value, time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(k) AS start
            FROM s, (SELECT unnest([0, 1, 2, 3, 4]) AS k) o)
        SELECT cluster, pod_name, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS window_start, round(max(value), 6) AS peak, count(*) AS samples
        FROM w WHERE start + INTERVAL 5 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM s) - INTERVAL 10 MINUTE
        GROUP BY ALL HAVING max(value) > 900""",
)
def _(t):
    usage = t.metrics.where(F.col("metric") == USED).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = drained(ops.saturation_alarms(stream_of(usage), 900.0))
    return rows.select(
        "cluster", "pod_name", F.date_format("window_start", FORMAT).alias("window_start"), F.round("peak", 6).alias("peak"), "samples"
    )


@query(
    "stream_sessions",
    """WITH a AS (SELECT *, ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL AS opens FROM {failed_runs}
           WINDOW w AS (PARTITION BY cluster, dag_id, task_id ORDER BY ts, event_id)),
         b AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY cluster, dag_id, task_id ORDER BY ts, event_id) AS s FROM a)
       SELECT cluster, dag_id, task_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_at, count(*) AS n_alerts, max(attempt) AS last_try
       FROM b GROUP BY cluster, dag_id, task_id, s
       HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM {failed_runs}) - INTERVAL 10 MINUTE""",
)
def _(t):
    rows = drained(ops.incident_sessions(stream_of(alert_rows(t))))
    return rows.select(
        "cluster", "dag_id", "task_id", F.date_format("first_at", FORMAT).alias("first_at"), "n_alerts", "last_try"
    )


@query(
    "stream_correlate",
    """WITH mark AS (SELECT least((SELECT date_trunc('millisecond', max(ts)) FROM {failed_runs}),
           (SELECT date_trunc('millisecond', max(ts)) FROM {cloud_events})) - INTERVAL 10 MINUTE AS w),
         a AS (SELECT run_id, cluster, date_trunc('minute', ts) - INTERVAL 10 MINUTE AS start, date_trunc('minute', ts) + INTERVAL 11 MINUTE AS stop FROM {failed_runs})
       SELECT a.run_id AS alert_id, a.cluster, strftime(a.start, '%Y-%m-%d %H:%M:%S.%f') AS slot_start, count(e.insert_id) AS n_events,
         count(*) FILTER (WHERE e.severity = 'CRITICAL') AS n_critical
       FROM a LEFT JOIN {cloud_events} e ON a.cluster = e.cluster AND e.ts >= a.start AND e.ts < a.stop, mark
       WHERE a.stop <= mark.w GROUP BY ALL""",
)
def _(t):
    events = t.cloud_events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = drained(ops.correlate(stream_of(alert_rows(t)), stream_of(events)))
    return rows.withColumn("slot_start", F.date_format("slot_start", FORMAT))


derived.DERIVED["approval_pairs"] = """
SELECT run_id AS approval_id, ts, event_id, CASE WHEN event_id % 3 = 0 THEN 'REJECTED' ELSE 'APPROVED' END AS decision,
  cast(event_id % 90 AS int) AS wait_minutes, event_id % 4 > 0 AS answered FROM {failed_runs}
"""


@query(
    "stream_approvals",
    """WITH d AS (SELECT approval_id, decision, ts + to_minutes(wait_minutes) AS decided_at FROM {approval_pairs} WHERE answered),
         mark AS (SELECT least((SELECT date_trunc('millisecond', max(ts)) FROM {approval_pairs}),
           (SELECT date_trunc('millisecond', max(decided_at)) FROM d)) - INTERVAL 10 MINUTE AS w)
       SELECT q.approval_id, strftime(q.ts, '%Y-%m-%d %H:%M:%S.%f') AS requested_at, coalesce(d.decision, 'TIMED_OUT') AS status
       FROM {approval_pairs} q LEFT JOIN d ON q.approval_id = d.approval_id AND d.decided_at <= q.ts + INTERVAL 1 HOUR, mark
       WHERE d.decision IS NOT NULL OR q.ts + INTERVAL 1 HOUR < mark.w""",
)
def _(t):
    at = F.col("ts").cast("timestamp")
    requests = t.approval_pairs.select("approval_id", at.alias("requested_at"))
    decisions = t.approval_pairs.where("answered").select(
        "approval_id", "decision", (at + F.make_dt_interval(mins=F.col("wait_minutes"))).alias("decided_at")
    )
    rows = drained(ops.await_approvals(stream_of(requests), stream_of(decisions)))
    return rows.withColumn("requested_at", F.date_format("requested_at", FORMAT))


@query(
    "stream_approval_states",
    """WITH d AS (SELECT approval_id, decision, ts + to_minutes(wait_minutes) AS decided_at FROM {approval_pairs} WHERE answered),
         mark AS (SELECT date_trunc('millisecond', greatest((SELECT max(ts) FROM {approval_pairs}), (SELECT max(decided_at) FROM d)))
           - INTERVAL 10 MINUTE AS w),
         final AS (SELECT q.approval_id, q.ts, d.decision, d.decided_at FROM {approval_pairs} q
           LEFT JOIN d ON q.approval_id = d.approval_id AND d.decided_at <= q.ts + INTERVAL 1 HOUR),
         states AS (SELECT approval_id, 'PENDING' AS status, ts AS since FROM final
           UNION ALL SELECT approval_id, decision, decided_at FROM final WHERE decision IS NOT NULL
           UNION ALL SELECT approval_id, 'TIMED_OUT', ts + INTERVAL 1 HOUR FROM final, mark WHERE decision IS NULL AND ts + INTERVAL 1 HOUR <= mark.w)
       SELECT approval_id, status, strftime(since, '%Y-%m-%d %H:%M:%S.%f') AS since FROM states""",
)
def _(t):
    at = F.col("ts").cast("timestamp")
    requests = t.approval_pairs.select("approval_id", at.alias("requested_at"))
    decisions = t.approval_pairs.where("answered").select(
        "approval_id", "decision", (at + F.make_dt_interval(mins=F.col("wait_minutes"))).alias("decided_at")
    )
    rows = drained(ops.approval_states(stream_of(requests), stream_of(decisions)))
    return rows.withColumn("since", F.date_format("since", FORMAT))


@query(
    "stream_late",
    """SELECT run_id AS alert_id, event_id % 25 > 10 AS is_late FROM {failed_runs}""",
)
def _(t):
    arrived = F.col("received_at") + F.make_dt_interval(
        mins=F.col("_id") % 25, secs=F.when(F.col("_id") % 25 == 10, F.lit(0)).otherwise(F.lit(1))
    )
    rows = (
        alert_rows(t)
        .withColumn("_id", F.substring_index("alert_id", "_", -1).cast("int"))
        .withColumn("arrived_at", arrived)
    )
    on_time, late = scratch_dir(t.spark, "on-time"), scratch_dir(t.spark, "late")
    writer = ops.split_late(stream_of(rows), on_time, late)
    writer.option("checkpointLocation", scratch_dir(t.spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    read = t.spark.read.schema(rows.schema)
    parts = [
        read.parquet(path).select("alert_id", F.lit(flag).alias("is_late")) for path, flag in ((on_time, False), (late, True))
    ]
    return parts[0].unionByName(parts[1])
