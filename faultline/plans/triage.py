"""Classification, policy and routing queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions import coordinates as C
from faultline.functions.policy import PolicyLimits
from faultline.functions.sql import register_functions
from faultline.operators import triage as ops
from faultline.plans import derived
from faultline.plans.registry import Tables, query

derived.DERIVED["classified"] = """
SELECT *, CASE
  WHEN low LIKE '%exit code 137%' OR low LIKE '%oomkilled%' OR low LIKE '%out of memory%' THEN 'TRANSIENT_OOM'
  WHEN low LIKE '%terminatedbypreemption%' OR low LIKE '%preemption notice%' OR low LIKE '%exit code 143%' THEN 'TRANSIENT_SPOT_PREEMPTION'
  WHEN low LIKE '%no space left on device%' OR low LIKE '%ephemeral-storage%' OR low LIKE '%errno 28%' THEN 'TRANSIENT_DISK_FULL'
  WHEN low LIKE '%statement timeout%' THEN 'TRANSIENT_STATEMENT_TIMEOUT'
  WHEN low LIKE '%connection slots are reserved%' OR low LIKE '%connection pool exhausted%' THEN 'TRANSIENT_CONNECTION_POOL'
  WHEN low LIKE '%requesttimetooskewed%' OR low LIKE '%clock drifted%' THEN 'TRANSIENT_CLOCK_SKEW'
  WHEN low LIKE '%division by zero%' THEN 'STRUCTURAL_DIVISION_BY_ZERO'
  WHEN low LIKE '%zero rows in daily ingest%' OR contains(low, 'zero_rows_delivered') THEN 'SILENT_DATA_ANOMALY'
  WHEN low LIKE '%deadlockdetected%' OR low LIKE '%error 40p01%' OR low LIKE '%lock wait timeout%' THEN 'TRANSIENT_CONCURRENCY'
  WHEN low LIKE '%429%' OR low LIKE '%rate limit%' OR low LIKE '%too many requests%' THEN 'TRANSIENT_RATE_LIMIT'
  WHEN low LIKE '%duplicate keys found%' OR low LIKE '%data quality%' OR contains(low, 'fail unique_') THEN 'DATA_QUALITY'
  WHEN low LIKE '%column%' AND (low LIKE '%does not exist%' OR low LIKE '%not found%') THEN 'STRUCTURAL_SCHEMA_DRIFT'
  WHEN low LIKE '%syntax error%' OR low LIKE '%compilation error%' THEN 'STRUCTURAL_SYNTAX'
  WHEN low LIKE '%sensor has timed out%' OR low LIKE '%partition not ready%' THEN 'DEPENDENCY_LAG'
  WHEN low LIKE '%connection reset%' OR low LIKE '%connection timed out%' OR low LIKE '%503 service unavailable%' THEN 'TRANSIENT_NETWORK'
  ELSE 'UNKNOWN' END AS failure_category
FROM (SELECT *, lower(log_text) AS low FROM {task_runs} WHERE state = 'failed') f
"""

derived.DERIVED["leveled"] = """
SELECT *, CASE
  WHEN lower(operator) LIKE '%dbt%' OR lower(code) LIKE '%dbt%' THEN 'GUARANTEED_IDEMPOTENT'
  WHEN upper(code) LIKE '%INSERT OVERWRITE%' OR upper(code) LIKE '%MERGE INTO%' OR upper(code) LIKE '%TRUNCATE%' THEN 'GUARANTEED_IDEMPOTENT'
  WHEN upper(code) LIKE '%INSERT INTO%' AND upper(code) NOT LIKE '%ON CONFLICT%' AND upper(code) NOT LIKE '%WHERE NOT EXISTS%' THEN 'POTENTIALLY_UNSAFE'
  ELSE 'CONDITIONAL_IDEMPOTENT' END AS idempotency_level,
  CASE WHEN requested_memory IS NULL OR requested_memory = 0 THEN 4096 ELSE requested_memory END AS mem
FROM {classified}
"""

derived.DERIVED["decided"] = """
SELECT *,
  CASE WHEN failure_category = 'DEPENDENCY_LAG' THEN true
    WHEN failure_category IN ('DATA_QUALITY', 'STRUCTURAL_SCHEMA_DRIFT', 'STRUCTURAL_DIVISION_BY_ZERO',
      'SILENT_DATA_ANOMALY', 'STRUCTURAL_SYNTAX', 'TRANSIENT_NETWORK', 'UNKNOWN') THEN false
    WHEN failure_category = 'TRANSIENT_OOM' AND mem > 16384 THEN false
    ELSE attempt <= 2 AND idempotency_level <> 'POTENTIALLY_UNSAFE' END AS can_auto_remediate,
  CASE failure_category
    WHEN 'TRANSIENT_OOM' THEN CASE WHEN mem > 16384 THEN 'ESCALATE_TO_HUMAN' ELSE 'BUMP_POD_MEMORY_AND_CLEAR' END
    WHEN 'TRANSIENT_CONCURRENCY' THEN 'CLEAR_TASK_INSTANCE'
    WHEN 'TRANSIENT_RATE_LIMIT' THEN 'CLEAR_TASK_INSTANCE'
    WHEN 'DATA_QUALITY' THEN 'ALERT_DATA_STEWARDS'
    WHEN 'STRUCTURAL_SCHEMA_DRIFT' THEN 'CREATE_GITHUB_PR'
    WHEN 'TRANSIENT_SPOT_PREEMPTION' THEN 'RESCHEDULE_ON_DEMAND_POOL'
    WHEN 'TRANSIENT_DISK_FULL' THEN 'BUMP_EPHEMERAL_STORAGE_AND_CLEAR'
    WHEN 'TRANSIENT_STATEMENT_TIMEOUT' THEN 'BUMP_STATEMENT_TIMEOUT_AND_CLEAR'
    WHEN 'TRANSIENT_CONNECTION_POOL' THEN 'THROTTLE_CONCURRENCY_AND_CLEAR'
    WHEN 'TRANSIENT_CLOCK_SKEW' THEN 'RESCHEDULE_SYNCED_NODE_AND_CLEAR'
    WHEN 'STRUCTURAL_DIVISION_BY_ZERO' THEN 'CREATE_GITHUB_PR'
    WHEN 'SILENT_DATA_ANOMALY' THEN 'PAUSE_DOWNSTREAM_DAG_AND_ALERT'
    WHEN 'DEPENDENCY_LAG' THEN 'TRIGGER_UPSTREAM_DAG'
    ELSE 'ESCALATE_TO_HUMAN' END AS recommended_action,
  CASE failure_category
    WHEN 'TRANSIENT_OOM' THEN CASE WHEN mem > 16384 THEN ''
      ELSE 'memory_limit=' || cast(mem AS string) || 'Mi;memory_request=' || cast(IDIV(mem, 2) AS string) || 'Mi' END
    WHEN 'TRANSIENT_CONCURRENCY' THEN 'backoff_seconds=10'
    WHEN 'TRANSIENT_RATE_LIMIT' THEN 'backoff_seconds=30'
    WHEN 'TRANSIENT_SPOT_PREEMPTION' THEN 'node_pool=on-demand-pool'
    WHEN 'TRANSIENT_DISK_FULL' THEN 'ephemeral_storage_limit=50Gi'
    WHEN 'TRANSIENT_STATEMENT_TIMEOUT' THEN 'statement_timeout=2h'
    WHEN 'TRANSIENT_CONNECTION_POOL' THEN 'max_active_tasks=8'
    WHEN 'TRANSIENT_CLOCK_SKEW' THEN 'ntp_sync=true'
    WHEN 'DEPENDENCY_LAG' THEN 'upstream_cluster=gke-analytics-europe-west1;upstream_dag_id=eu_raw_ingestion_hourly'
    ELSE '' END AS parameters,
  cast(CASE WHEN attempt > 2 THEN 1 ELSE 0 END
    + CASE WHEN idempotency_level = 'POTENTIALLY_UNSAFE' THEN 1 ELSE 0 END
    + CASE WHEN failure_category = 'TRANSIENT_OOM' AND mem > 16384 THEN 1 ELSE 0 END AS int) AS n_violations
FROM {leveled}
"""

derived.DERIVED["routed"] = """
SELECT *,
  failure_category = 'STRUCTURAL_SCHEMA_DRIFT' AS requires_human,
  CASE WHEN failure_category = 'STRUCTURAL_SCHEMA_DRIFT' THEN 'MERGE_PR_AND_RESUME_PIPELINE'
    ELSE recommended_action END AS remediation_action,
  CASE WHEN failure_category = 'STRUCTURAL_SCHEMA_DRIFT' THEN 'PENDING' ELSE 'AUTO_APPROVED' END AS approval_status,
  CASE WHEN failure_category = 'STRUCTURAL_SCHEMA_DRIFT' THEN 'approval'
    WHEN can_auto_remediate THEN 'execute' ELSE 'report' END AS route
FROM {decided}
"""


def pairs(column: str) -> Column:
    """A string map as sorted ``key=value`` text."""
    entries = F.transform(
        F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return F.array_join(F.array_sort(entries), ";")


def decisions(t: Tables) -> DataFrame:
    return ops.evaluate_policy(ops.classify_failures(t.failed_runs))


def routed(t: Tables) -> DataFrame:
    return ops.route_incidents(decisions(t))


@query("classify_failures", "SELECT run_id, cluster, dag_id, failure_category FROM {classified}")
def _(t):
    return ops.classify_failures(t.failed_runs).select("run_id", "cluster", "dag_id", "failure_category")


@query(
    "classify_strict",
    """SELECT run_id, CASE
      WHEN failure_category = 'TRANSIENT_RATE_LIMIT' AND NOT regexp_matches(low, '\\b429\\b')
        AND low NOT LIKE '%rate limit%' AND low NOT LIKE '%too many requests%' THEN
        CASE WHEN low LIKE '%duplicate keys found%' OR low LIKE '%data quality%' OR contains(low, 'fail unique_') THEN 'DATA_QUALITY'
          WHEN low LIKE '%column%' AND (low LIKE '%does not exist%' OR low LIKE '%not found%') THEN 'STRUCTURAL_SCHEMA_DRIFT'
          WHEN low LIKE '%syntax error%' OR low LIKE '%compilation error%' THEN 'STRUCTURAL_SYNTAX'
          WHEN low LIKE '%sensor has timed out%' OR low LIKE '%partition not ready%' THEN 'DEPENDENCY_LAG'
          WHEN low LIKE '%connection reset%' OR low LIKE '%connection timed out%' OR low LIKE '%503 service unavailable%' THEN 'TRANSIENT_NETWORK'
          ELSE 'UNKNOWN' END
      ELSE failure_category END AS failure_category FROM {classified}""",
)
def _(t):
    return ops.classify_failures(t.failed_runs, strict=True).select("run_id", "failure_category")


@query(
    "idempotency_levels",
    "SELECT operator, idempotency_level, count(*) AS n FROM {leveled} GROUP BY ALL",
)
def _(t):
    rows = ops.check_idempotency(t.failed_runs)
    return rows.groupBy("operator", "idempotency_level").agg(F.count("*").alias("n"))


@query(
    "policy_decisions",
    """SELECT run_id, attempt, failure_category, idempotency_level, can_auto_remediate,
         recommended_action, parameters, n_violations FROM {decided}""",
)
def _(t):
    return decisions(t).select(
        "run_id",
        "attempt",
        "failure_category",
        "idempotency_level",
        "can_auto_remediate",
        "recommended_action",
        pairs("action_parameters").alias("parameters"),
        F.size("violations").alias("n_violations"),
    )


@query(
    "route_incidents",
    """SELECT run_id, failure_category, requires_human, remediation_action, approval_status, route
       FROM {routed}""",
)
def _(t):
    return routed(t).select(
        "run_id", "failure_category", "requires_human", "remediation_action", "approval_status", "route"
    )


@query(
    "approval_queue",
    """SELECT 'apr-' || sha256(cluster || '/' || dag_id || '/' || task_id || '/' || run_id || '/'
         || cast(attempt AS string)) AS approval_id, cluster, dag_id, task_id, run_id,
         remediation_action AS action_type, 'merge the drafted change and clear the task' AS proposed_change,
         'MEDIUM' AS risk_level,
         CASE WHEN dag_id LIKE '%dbt%' THEN '#team-analytics-eng' ELSE '#data-platform-alerts' END AS channel,
         failure_category AS root_cause, approval_status AS status
       FROM {routed} WHERE requires_human""",
)
def _(t):
    return ops.approval_requests(routed(t)).drop("code_diff", "pr_url")


@query(
    "remediation_ledger",
    """SELECT run_id, CASE WHEN ok THEN 'SUCCESS' ELSE 'FAILED' END AS status,
         remediation_action AS action_taken,
         CASE WHEN up THEN 'gke-analytics-europe-west1' ELSE cluster END AS cluster,
         CASE WHEN up THEN 'eu_raw_ingestion_hourly' ELSE dag_id END AS dag_id,
         CASE WHEN NOT up THEN task_id END AS task_id,
         remediation_action IN ('BUMP_POD_MEMORY_AND_CLEAR', 'CLEAR_TASK_INSTANCE', 'TRIGGER_UPSTREAM_DAG',
           'MERGE_PR_AND_RESUME_PIPELINE') AS retry_scheduled,
         parameters
       FROM (SELECT *, remediation_action IN ('BUMP_POD_MEMORY_AND_CLEAR', 'CLEAR_TASK_INSTANCE',
           'TRIGGER_UPSTREAM_DAG', 'CREATE_GITHUB_PR', 'MERGE_PR_AND_RESUME_PIPELINE') AS ok,
           remediation_action = 'TRIGGER_UPSTREAM_DAG' AS up
         FROM {routed} WHERE route <> 'report') r""",
)
def _(t):
    ledger = ops.remediation_ledger(routed(t))
    return ledger.withColumn("parameters", pairs("parameters")).drop("details", "backoff_seconds")


@query(
    "incident_report",
    """SELECT cluster, dag_id, task_id, run_id, failure_category, remediation_action, approval_status,
         CASE WHEN NOT requires_human AND can_auto_remediate THEN 'RESOLVED_AUTOMATICALLY'
           ELSE 'NEEDS_HUMAN' END AS outcome,
         dag_id || '.' || task_id || ' on ' || cluster || ': ' || failure_category || ', '
           || idempotency_level || ' gate, action ' || remediation_action AS summary
       FROM {routed}""",
)
def _(t):
    return ops.incident_report(routed(t))


@query(
    "incident_rollup",
    """SELECT cluster, dag_id, failure_category, count(*) AS incidents,
         count(*) FILTER (WHERE route = 'execute') AS auto_resolved,
         cast(grouping(cluster, dag_id, failure_category) AS int) AS level,
         round(count(*) FILTER (WHERE route = 'execute') / count(*), 6) AS auto_rate
       FROM {routed} GROUP BY ROLLUP (cluster, dag_id, failure_category)""",
)
def _(t):
    return ops.incident_rollup(routed(t))


@query(
    "policy_strict_gates",
    """SELECT run_id, CASE WHEN failure_category = 'DEPENDENCY_LAG' THEN attempt <= 2 AND idempotency_level <> 'POTENTIALLY_UNSAFE'
         ELSE can_auto_remediate END AS can_auto_remediate FROM {decided}""",
)
def _(t):
    strict = ops.evaluate_policy(ops.classify_failures(t.failed_runs), PolicyLimits(strict_gates=True))
    return strict.select("run_id", "can_auto_remediate")


@query(
    "policy_inferred_code",
    """SELECT run_id, CASE WHEN event_id % 2 = 0 THEN code WHEN dag_id LIKE '%dbt%' THEN 'dbt run' ELSE 'MERGE INTO' END AS code,
         CASE WHEN event_id % 2 = 0 THEN idempotency_level ELSE 'GUARANTEED_IDEMPOTENT' END AS idempotency_level FROM {leveled}""",
)
def _(t):
    known = F.when(F.col("event_id") % 2 == 0, F.col("code"))
    rows = ops.check_idempotency(ops.infer_code(t.failed_runs.withColumn("code", known)))
    return rows.select("run_id", "code", "idempotency_level")


@query(
    "route_reviewed",
    """SELECT run_id, CASE WHEN failure_category = 'STRUCTURAL_DIVISION_BY_ZERO' THEN 'approval' ELSE route END AS route FROM {routed}""",
)
def _(t):
    rows = ops.route_incidents(decisions(t), ("STRUCTURAL_SCHEMA_DRIFT", "STRUCTURAL_DIVISION_BY_ZERO"))
    return rows.select("run_id", "route")


@query(
    "action_quantities",
    """SELECT run_id, CASE failure_category WHEN 'TRANSIENT_OOM' THEN mem WHEN 'TRANSIENT_DISK_FULL' THEN 51200 ELSE -1 END AS mib,
         CASE failure_category WHEN 'TRANSIENT_STATEMENT_TIMEOUT' THEN 7200 ELSE -1 END AS seconds
       FROM {decided} WHERE parameters <> ''""",
)
def _(t):
    params = F.col("action_parameters")
    size = F.coalesce(params["memory_limit"], params["ephemeral_storage_limit"])
    return decisions(t).where(F.size(params) > 0).select(
        "run_id",
        F.coalesce(C.memory_mib(size), F.lit(-1)).cast("int").alias("mib"),
        F.coalesce(C.duration_seconds(params["statement_timeout"]), F.lit(-1)).cast("int").alias("seconds"),
    )


@query(
    "sql_functions",
    """SELECT run_id, failure_category, idempotency_level, round(10.0 / nullif(attempt - 2, 0), 6) AS ratio FROM {leveled}""",
)
def _(t):
    register_functions(t.spark)
    return t.spark.sql(
        """SELECT run_id, failure_category(log_text) AS failure_category, idempotency_level(operator, code) AS idempotency_level,
             round(safe_ratio(10, attempt - 2), 6) AS ratio FROM {runs}""",
        runs=t.failed_runs,
    )
