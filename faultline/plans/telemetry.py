"""Queries over cloud events and metric series."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import logs as log_ops
from faultline.operators import telemetry as ops
from faultline.operators import triage
from faultline.plans import derived
from faultline.plans.registry import query
from faultline.session import scratch_dir

FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
USED, ALLOWED, LOCKS = (
    "container_memory_working_set_bytes", "container_spec_memory_limit_bytes", "pg_stat_database_deadlocks"
)

derived.DERIVED["cloud_events"] = """
SELECT 'ev-' || cast(event_id AS string) AS insert_id, ts, cluster,
  CASE event_type WHEN 'signup' THEN CASE WHEN value > 60 THEN 'CRITICAL' ELSE 'WARNING' END
    WHEN 'purchase' THEN 'ERROR' ELSE 'INFO' END AS severity,
  CASE WHEN event_type = 'purchase' THEN 'cloudsql_database' ELSE 'k8s_container' END AS resource_type,
  'airflow-worker-' || task_id || '-pod' AS pod_name,
  CASE WHEN event_type = 'purchase' THEN 1000 + user_id % 40 END AS process_id,
  CASE WHEN event_type = 'purchase' THEN 1000 + event_id % 40 END AS blocked_by,
  value
FROM {runs_base} WHERE event_type <> 'error'
"""

derived.DERIVED["metrics"] = """
SELECT cluster, 'container_memory_working_set_bytes' AS metric, 'airflow-worker-' || task_id || '-pod' AS pod_name, ts, event_id,
  value * 8 AS value FROM {runs_base} WHERE event_type IN ('click', 'view')
UNION ALL
SELECT cluster, 'container_spec_memory_limit_bytes', 'airflow-worker-' || task_id || '-pod', ts, event_id,
  cast(1024 AS double) FROM {runs_base} WHERE event_type IN ('click', 'view')
UNION ALL
SELECT cluster, 'pg_stat_database_deadlocks', 'airflow-worker-' || task_id || '-pod', ts, event_id,
  cast(CASE WHEN value > 100 THEN 1 ELSE 0 END AS double) FROM {runs_base} WHERE event_type = 'signup'
"""

derived.DERIVED["spans"] = """
SELECT run_id, cluster, dag_id, ts, US(ts) + cast(event_id % 5400 + 60 AS bigint) * 1000000 AS end_us FROM {runs_base}
"""

derived.DERIVED["dependencies"] = """
SELECT DISTINCT CASE WHEN user_id % 12 < 4 THEN 'dbt_marts_' ELSE 'dag_' END || cast(user_id % 12 AS string) AS dag_id,
  CASE (user_id + 5) % 3 WHEN 0 THEN 'us-prod-1' WHEN 1 THEN 'eu-analytics-1' ELSE 'apac-data-1' END AS upstream_cluster,
  CASE WHEN (user_id + 5) % 12 < 4 THEN 'dbt_marts_' ELSE 'dag_' END || cast((user_id + 5) % 12 AS string) AS upstream_dag_id
FROM {events}
"""

STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def micros(seconds: str):
    """Seconds as whole microseconds, which compare exactly."""
    return F.round(F.col(seconds) * 1e6).cast("long")


def failures(t):
    return t.failed_runs.select(
        "run_id", "cluster", "dag_id", "ts", F.concat(F.lit("airflow-worker-"), "task_id", F.lit("-pod")).alias("pod_name")
    )


@query(
    "pod_events",
    """SELECT insert_id, severity FROM {cloud_events}
       WHERE resource_type = 'k8s_container' AND pod_name = 'airflow-worker-task_1-pod' AND severity <> 'INFO'
       ORDER BY ts DESC, insert_id DESC LIMIT 20""",
)
def _(t):
    rows = ops.pod_events(t.cloud_events, "airflow-worker-task_1-pod", "severity <> 'INFO'")
    return rows.select("insert_id", "severity")


@query(
    "pod_events_each",
    """SELECT cluster, pod_name, insert_id, cast(rank AS int) AS rank FROM (
         SELECT *, row_number() OVER (PARTITION BY cluster, pod_name ORDER BY ts DESC, insert_id DESC) AS rank
         FROM {cloud_events} WHERE resource_type = 'k8s_container') e WHERE rank <= 20""",
)
def _(t):
    return ops.pod_events_each(t.cloud_events).select("cluster", "pod_name", "insert_id", "rank")


PIVOTAL = """
  LEFT JOIN (SELECT f.run_id, arg_min(e.insert_id, e.ts) FILTER (WHERE e.severity = 'CRITICAL') AS crit,
      arg_max(e.insert_id, e.ts) AS latest, arg_max(e.severity, e.ts) AS latest_severity,
      count(*) AS n_events, count(*) FILTER (WHERE e.severity IN ('ERROR', 'CRITICAL')) AS n_errors,
      count(*) FILTER (WHERE e.severity = 'CRITICAL') AS n_critical
    FROM {failed_runs} f JOIN {cloud_events} e ON f.cluster = e.cluster
      AND e.ts BETWEEN f.ts - INTERVAL 10 MINUTE AND f.ts + INTERVAL 10 MINUTE GROUP BY f.run_id) p ON r.run_id = p.run_id"""


@query(
    "pivotal_event",
    """SELECT r.run_id, coalesce(crit, latest) AS pivotal_id,
         CASE WHEN crit IS NOT NULL THEN 'CRITICAL' ELSE latest_severity END AS pivotal_severity
       FROM {failed_runs} r""" + PIVOTAL,
)
def _(t):
    return ops.attach_telemetry(failures(t), t.cloud_events).select("run_id", "pivotal_id", "pivotal_severity")


@query(
    "attach_telemetry",
    """SELECT r.run_id, r.cluster, coalesce(n_events, 0) AS n_events, coalesce(n_errors, 0) AS n_errors,
         coalesce(n_critical, 0) AS n_critical, coalesce(crit, latest) AS pivotal_id
       FROM {failed_runs} r""" + PIVOTAL,
)
def _(t):
    return ops.attach_telemetry(failures(t), t.cloud_events).select(
        "run_id", "cluster", "n_events", "n_errors", "n_critical", "pivotal_id"
    )


# One cluster without the metric asked for, and one without a name.
derived.DERIVED["some_metrics"] = """
SELECT nullif(cluster, 'apac-data-1') AS cluster, metric, value FROM {metrics}
WHERE cluster <> 'us-prod-1' OR metric <> 'pg_stat_database_deadlocks'
"""


@query(
    "metric_pick",
    """WITH named AS (SELECT DISTINCT cluster, metric, contains(metric, 'stat_database') AS hit FROM {some_metrics}),
         picked AS (SELECT cluster, coalesce(min(metric) FILTER (WHERE hit), min(metric)) AS metric FROM named GROUP BY cluster)
       SELECT m.cluster, m.metric, count(*) AS n, cast(sum(cast(value AS decimal(18,2))) AS double) AS total
       FROM {some_metrics} m JOIN picked p ON m.cluster IS NOT DISTINCT FROM p.cluster AND m.metric = p.metric GROUP BY ALL""",
)
def _(t):
    rows = ops.metric_pick(t.some_metrics, "stat_database")
    return rows.groupBy("cluster", "metric").agg(
        F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")
    )


@query(
    "metric_asof",
    f"""SELECT f.run_id, {STAMP.format('m.ts')} AS sample_ts, m.value AS sample_value
        FROM (SELECT run_id, cluster, ts, 'airflow-worker-' || task_id || '-pod' AS pod_name FROM {{failed_runs}}) f
        ASOF LEFT JOIN (SELECT * FROM {{metrics}} WHERE metric = '{USED}') m
          ON f.cluster = m.cluster AND f.pod_name = m.pod_name AND f.ts >= m.ts""",
)
def _(t):
    rows = ops.metric_at_failure(failures(t), t.metrics, USED)
    return rows.select("run_id", F.date_format("sample_ts", FORMAT).alias("sample_ts"), "sample_value")


@query(
    "upstream_cause",
    """SELECT f.run_id, d.upstream_cluster, d.upstream_dag_id, u.run_id AS upstream_run_id
       FROM (SELECT * FROM {classified} WHERE failure_category = 'DEPENDENCY_LAG') f
       JOIN {dependencies} d ON f.dag_id = d.dag_id
       ASOF JOIN {task_runs} u ON u.cluster = d.upstream_cluster AND u.dag_id = d.upstream_dag_id AND f.ts >= u.ts
       WHERE u.state = 'failed'""",
)
def _(t):
    late = triage.classify_failures(t.failed_runs).where("failure_category = 'DEPENDENCY_LAG'")
    runs = t.task_runs.select("cluster", "dag_id", "ts", "run_id", "state")
    return ops.upstream_cause(late.select("run_id", "dag_id", "ts"), t.dependencies, runs).select(
        "run_id", "upstream_cluster", "upstream_dag_id", "upstream_run_id"
    )


@query(
    "missing_partitions",
    """WITH have AS (SELECT DISTINCT cluster, dag_id, date_trunc('hour', ts) AS part FROM {task_runs} WHERE state = 'success'),
         span AS (SELECT cluster, dag_id, min(date_trunc('hour', ts)) AS first, max(date_trunc('hour', ts)) + INTERVAL 3 HOUR AS until
           FROM {task_runs} GROUP BY ALL),
         want AS (SELECT cluster, dag_id, unnest(generate_series(first, until, INTERVAL 1 HOUR)) AS part FROM span)
       SELECT w.cluster, w.dag_id, strftime(w.part, '%Y-%m-%d %H:%M:%S.%f') AS part,
         coalesce(cast(epoch(w.part) - epoch(max(b.part)) AS bigint), -1) AS lag_seconds
       FROM (SELECT * FROM want ANTI JOIN have USING (cluster, dag_id, part)) w
       LEFT JOIN have b ON w.cluster = b.cluster AND w.dag_id = b.dag_id AND b.part < w.part GROUP BY w.cluster, w.dag_id, w.part""",
)
def _(t):
    keys = ["cluster", "dag_id"]
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    # The calendar goes three hours past the last run of any kind: a sensor waits for those.
    spans = t.task_runs.groupBy(*keys).agg(F.min(hour).alias("first"), (F.max(hour) + F.expr("interval 3 hours")).alias("until"))
    expected = ops.partition_calendar(spans, keys, "first", "until")
    present = t.task_runs.where("state = 'success'").select(*keys, F.col("ts").cast("timestamp").alias("ts"))
    rows = ops.missing_partitions(expected, present, keys, "ts")
    return rows.select(
        *keys, F.date_format("part", FORMAT).alias("part"), F.coalesce("lag_seconds", F.lit(-1)).alias("lag_seconds")
    )


@query(
    "deadlock_pairs",
    r"""WITH edge AS (
         SELECT cluster, substr(cast(ts AS string), 1, 10) AS day, process_id, blocked_by FROM {cloud_events} WHERE process_id IS NOT NULL
         UNION ALL
         SELECT cluster, substr(cast(ts AS string), 1, 10), cast(regexp_extract(log_text, 'Process (\d+) waits', 1) AS bigint),
           cast(regexp_extract(log_text, 'blocked by process (\d+)', 1) AS bigint)
         FROM {failed_runs} WHERE log_text LIKE '%waits for ShareLock%'),
       n AS (SELECT cluster, day, process_id, blocked_by, count(*) AS n FROM edge GROUP BY ALL)
       SELECT a.cluster, a.day, a.process_id AS process_a, a.blocked_by AS process_b, a.n AS a_waits, b.n AS b_waits
       FROM n a JOIN n b ON a.cluster = b.cluster AND a.day = b.day AND a.process_id = b.blocked_by AND a.blocked_by = b.process_id
       WHERE a.process_id < a.blocked_by""",
)
def _(t):
    day = F.substring(F.col("ts").cast("string"), 1, 10).alias("day")
    scope = ["cluster", "day"]
    stated = t.cloud_events.where("process_id IS NOT NULL").select("cluster", day, "process_id", "blocked_by")
    logged = ops.wait_edges(t.failed_runs.select("cluster", day, "log_text"), scope)
    return ops.deadlock_pairs(stated.unionByName(logged), scope)


derived.DERIVED["usage"] = f"""
SELECT cluster, pod_name, ts, max(CASE WHEN metric = '{USED}' THEN value END) AS used,
  max(CASE WHEN metric = '{ALLOWED}' THEN value END) AS allowed
FROM {{metrics}} WHERE metric IN ('{USED}', '{ALLOWED}') GROUP BY cluster, pod_name, ts
"""


def usage(t):
    return ops.usage_against_limit(t.metrics, USED, ALLOWED, ["cluster", "pod_name"])


@query(
    "metric_saturation",
    """SELECT cluster, pod_name, round(max(used), 6) AS peak, round(avg(used), 6) AS mean, round(arg_max(used, ts), 6) AS last,
         round(max(used / allowed), 6) AS peak_share,
         cast(sum(CASE WHEN used > allowed * 0.9 AND next IS NOT NULL THEN epoch_us(next) - epoch_us(ts) ELSE 0 END) AS bigint) AS micros_above
       FROM (SELECT *, lead(ts) OVER (PARTITION BY cluster, pod_name ORDER BY ts) AS next FROM {usage}) u
       GROUP BY cluster, pod_name""",
)
def _(t):
    rows = ops.metric_saturation(usage(t), ["cluster", "pod_name"])
    return rows.select(
        "cluster", "pod_name", *[F.round(c, 6).alias(c) for c in ("peak", "mean", "last", "peak_share")],
        micros("seconds_above").alias("micros_above"),
    )


@query(
    "spike_recovery",
    f"""WITH m AS (SELECT * FROM {{metrics}} WHERE metric = '{LOCKS}'),
          s AS (SELECT cluster, pod_name, max(value) AS peak, arg_max(value, ts) AS last,
            max(ts) FILTER (WHERE value <> 0) AS high FROM m GROUP BY ALL)
        SELECT s.cluster, s.pod_name, peak, last, peak > 0 AND last = 0 AS is_transient,
          coalesce(epoch_us((SELECT min(m.ts) FROM m WHERE m.cluster = s.cluster AND m.pod_name = s.pod_name AND m.ts > s.high))
            - epoch_us(high), -1) AS recovery_micros FROM s""",
)
def _(t):
    rows = ops.spike_recovery(t.metrics.where(F.col("metric") == LOCKS), ["cluster", "pod_name"])
    waited = F.coalesce(micros("recovery_seconds"), F.lit(-1))
    return rows.withColumn("recovery_micros", waited).drop("recovery_seconds")


@query(
    "memory_trend",
    """SELECT cluster, pod_name, round(slope, 6) AS slope_per_hour, round(last, 6) AS last,
         CASE WHEN slope > 0 THEN round((allowed - last) / slope, 3) END AS hours_to_limit
       FROM (SELECT cluster, pod_name, regr_slope(used, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9) AS slope,
           arg_max(used, ts) AS last, arg_max(allowed, ts) AS allowed FROM {usage} GROUP BY ALL) u""",
)
def _(t):
    origin = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = ops.memory_trend(usage(t), ["cluster", "pod_name"], origin)
    return rows.select(
        "cluster", "pod_name", F.round("slope_per_hour", 6).alias("slope_per_hour"),
        F.round("last", 6).alias("last"), F.round("hours_to_limit", 3).alias("hours_to_limit"),
    )


@query(
    "concurrency_peak",
    """WITH step AS (SELECT dag_id, US(ts) AS t, 1 AS d FROM {spans} UNION ALL SELECT dag_id, end_us, -1 FROM {spans}),
         inst AS (SELECT dag_id, t, sum(d) AS d FROM step GROUP BY ALL),
         run AS (SELECT dag_id, sum(d) OVER (PARTITION BY dag_id ORDER BY t) AS n FROM inst)
       SELECT dag_id, cast(max(n) AS bigint) AS peak, max(n) > 5 AS over_limit FROM run GROUP BY dag_id""",
)
def _(t):
    spans = t.spans.select("dag_id", F.col("ts").cast("timestamp").alias("ts"), F.timestamp_micros("end_us").alias("end"))
    return ops.concurrency_peak(spans, ["dag_id"], "ts", "end", 5)


@query(
    "incident_timeline",
    """WITH rows AS (
         SELECT cluster, ts, 'event' AS kind, insert_id AS ref, severity AS detail FROM {cloud_events}
         UNION ALL SELECT cluster, ts, 'metric', metric || '#' || cast(event_id AS string), metric FROM {metrics}
         UNION ALL SELECT cluster, strptime(stamp, '%Y-%m-%dT%H:%M:%S.%g'), 'log', run_id || '#' || cast(rec AS string), level
         FROM (SELECT run_id, cluster, line_no, line, level, substr(line, 2, 23) AS stamp,
             row_number() OVER (PARTITION BY run_id ORDER BY line_no) - 1 AS rec
           FROM {log_lines} WHERE NOT is_continuation) l)
       SELECT cluster, kind, ref, detail, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at,
         coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY cluster ORDER BY ts, kind || '/' || ref)), -1) AS gap_micros
       FROM rows""",
)
def _(t):
    records = log_ops.parse_records(t.task_runs, ["run_id", "cluster"]).select(
        "cluster", F.col("logged_at").alias("ts"),
        F.concat_ws("#", "run_id", F.col("record_no").cast("string")).alias("ref"), "level",
    )
    # The logs are parsed once; what the timeline reads twice is the narrow result.
    path = scratch_dir(t.spark, "records")
    records.write.parquet(path)
    records = t.spark.read.schema(records.schema).parquet(path)
    events = t.cloud_events.select("cluster", F.col("ts").cast("timestamp").alias("ts"), F.col("insert_id").alias("ref"), "severity")
    metrics = t.metrics.select(
        "cluster", F.col("ts").cast("timestamp").alias("ts"),
        F.concat_ws("#", "metric", F.col("event_id").cast("string")).alias("ref"), "metric",
    )
    rows = ops.incident_timeline(records, events, metrics)
    return rows.select(
        "cluster", "kind", "ref", "detail", F.date_format("ts", FORMAT).alias("at"),
        F.coalesce(micros("gap_seconds"), F.lit(-1)).alias("gap_micros"),
    )
