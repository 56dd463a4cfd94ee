"""Queries over alerts, task records, owners and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import coordinates as C
from faultline.functions import text as X
from faultline.operators import alerts as ops
from faultline.operators import flow, ownership
from faultline.operators import logs as log_ops
from faultline.plans import derived
from faultline.plans.registry import query

derived.DERIVED["alerts"] = """
SELECT run_id AS alert_id, ts, attempt AS try_number, log_text,
  CASE event_id % 4
    WHEN 0 THEN 'Task failed on cluster ''' || cluster || ''' in DAG ''' || dag_id || ''' task ''' || task_id
      || ''' run ''' || run_id || '''. Please look.'
    WHEN 1 THEN 'seen on cluster "' || cluster || '", dag_id=' || dag_id || ', task_id=''' || task_id || ''' again'
    WHEN 2 THEN 'no coordinates given'
    ELSE 'only cluster ''' || cluster || ''' is known, and run ''' || run_id END AS prompt,
  CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'payload-' || cluster END AS cluster,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '' ELSE 'payload_' || dag_id END AS dag_id,
  CASE WHEN event_id % 7 > 2 THEN task_id END AS task_id,
  CASE WHEN event_id % 2 = 0 THEN run_id ELSE '' END AS run_id,
  CASE WHEN event_id % 6 > 1 THEN operator ELSE '' END AS operator
FROM {task_runs} WHERE event_type = 'error'
"""

derived.DERIVED["contexts"] = """
SELECT event_id, cluster, 'host-' || task_id AS pod_name,
  CASE WHEN event_id % 3 = 0 THEN dag_id END AS dag,
  CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE run_id END AS run_id,
  CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE execution_date END AS execution_date,
  event_id % 4 <> 0 AS has_ti,
  dag_id AS ti_dag, task_id AS ti_task, 'ti_' || run_id AS ti_run, attempt AS ti_try, operator AS ti_operator,
  'ti_' || execution_date AS ti_date,
  CASE WHEN event_id % 6 < 3 THEN 'ValueError' END AS exception_type,
  CASE WHEN event_id % 6 < 3 THEN 'bad value ' || cast(event_id AS string) END AS exception_message
FROM {task_runs} WHERE event_type = 'error'
"""

derived.DERIVED["task_records"] = """
SELECT run_id, task_id, CASE WHEN event_id % 3 > 0 THEN state END AS state,
  CASE WHEN event_id % 4 > 0 THEN attempt END AS try_number,
  CASE WHEN event_id % 5 > 0 THEN cast(3 AS int) END AS max_tries,
  CASE WHEN event_id % 6 > 0 THEN operator END AS operator,
  CASE WHEN event_id % 7 > 0 THEN 'pod-' || run_id END AS pod_name,
  CASE WHEN event_id % 8 > 0 THEN value END AS duration_seconds
FROM {task_runs}
"""

derived.DERIVED["catalog_rows"] = """
SELECT * FROM (VALUES
  (0, 'analytics-dbt', 'https://git.example.com/analytics-dbt', 'main', 'models/', '@analytics-engineering',
    '#data-platform-alerts', 'dbt_marts_0,dbt_marts_1,dag_5', 'dbt-core'),
  (1, 'financial-core-sql', 'https://git.example.com/financial-core-sql', 'release', 'queries/settlements', '@fintech',
    '#fintech', 'dag_5,dag_6,dag_7', 'custom-sql'),
  (2, 'data-lake-ingestion', 'https://git.example.com/data-lake-ingestion', 'main', '', '@data-infra',
    '#data-infra', 'dag_8,dbt_marts_0', 'airflow-native'))
AS c(ord, repo_name, repo_url, default_branch, code_subpath, team_owner, slack_channel, dags, framework)
"""

derived.DERIVED["manifest_nodes"] = """
SELECT c_custkey AS ord, 'model.finance.load_' || cast(c_custkey * 7 + 3 AS string) || '_d' AS node_id,
  CASE WHEN c_custkey % 3 > 0 THEN 'models/m_' || cast(c_custkey AS string) || '.sql' END AS original_file_path
FROM {customer}
"""

derived.DERIVED["owned"] = """
SELECT run_id, dag_id, ts,
  'load_' || cast(user_id AS string) || CASE WHEN user_id % 2 = 0 THEN '_d' ELSE '' END AS task_id,
  CASE WHEN user_id % 10 = 0 THEN 'https://git.example.com/team/repo_' || cast(user_id % 7 AS string) || '.git' END AS git_repo,
  CASE WHEN user_id % 4 = 0 THEN 'develop' END AS git_branch,
  CASE user_id % 6 WHEN 1 THEN 'owner:me,repo:financial-core-sql' WHEN 2 THEN 'repo:missing,repo:analytics-dbt,repo:data-lake-ingestion'
    WHEN 3 THEN 'repo:missing' WHEN 4 THEN 'repo:data-lake-ingestion' END AS tags,
  CASE event_id % 9 WHEN 0 THEN 'models/m_' || cast(user_id AS string) || '.sql' WHEN 1 THEN '' END AS hint
FROM {task_runs} WHERE event_type = 'error'
"""

derived.DERIVED["service_levels"] = """
SELECT * FROM (VALUES ('dbt_marts_0', 1, '@analytics'), ('dbt_marts_1', 1, '@analytics'), ('dbt_marts_2', 2, '@analytics'),
  ('dag_5', 1, '@fintech'), ('dag_6', 2, '@fintech'), ('dag_7', 3, '@fintech'), ('dag_8', 2, '@infra'), ('dag_9', 3, '@infra'))
AS s(dag_id, tier, team)
"""

derived.DERIVED["known_labels"] = """
SELECT * FROM (VALUES (0, 'dag_5', 'eu-analytics-1', 'deadlock'), (1, 'dag_6', 'us-prod-1', 'schema_drift'),
  (2, 'dag_5', 'us-prod-1', 'late_upstream')) AS l(ord, dag_id, cluster, scenario_id)
"""


def catalog(t):
    return t.catalog_rows.select(
        "ord", "repo_name", "repo_url", "default_branch", "code_subpath", "team_owner", "slack_channel",
        F.split("dags", ",").alias("matching_dags"), "framework",
    )


def owned(t):
    env = F.when(
        F.col("git_repo").isNotNull(),
        F.map_filter(
            F.create_map(F.lit("GIT_SYNC_REPO"), "git_repo", F.lit("GIT_SYNC_BRANCH"), "git_branch"),
            lambda k, v: v.isNotNull(),
        ),
    ).otherwise(F.create_map().cast("map<string,string>"))
    return t.owned.select(
        "run_id", "dag_id", "task_id", env.alias("env_vars"), F.split("tags", ",").alias("dag_tags"), "hint"
    )


@query(
    "alert_coordinates",
    r"""SELECT alert_id,
      CASE WHEN prompt LIKE '%cluster ''%' THEN regexp_extract(prompt, 'cluster ''([^'']*)', 1)
        WHEN prompt LIKE '%cluster %' THEN trim(split_part(split_part(prompt, 'cluster ', 2), ' ', 1), ''',"')
        ELSE coalesce(nullif(cluster, ''), 'gke-prod-us-central1') END AS cluster,
      CASE WHEN prompt LIKE '%DAG ''%' THEN split_part(split_part(prompt, 'DAG ''', 2), '''', 1)
        WHEN prompt LIKE '%dag_id=%' THEN trim(split_part(split_part(prompt, 'dag_id=', 2), ' ', 1), ''',"')
        ELSE coalesce(nullif(dag_id, ''), 'analytics_daily_etl') END AS dag_id,
      CASE WHEN prompt LIKE '%task ''%' THEN split_part(split_part(prompt, 'task ''', 2), '''', 1)
        WHEN prompt LIKE '%task_id=%' THEN trim(split_part(split_part(prompt, 'task_id=', 2), ' ', 1), ''',"')
        ELSE coalesce(nullif(task_id, ''), 'run_dbt_heavy_aggregation') END AS task_id,
      CASE WHEN prompt LIKE '%run ''%' THEN split_part(split_part(prompt, 'run ''', 2), '''', 1)
        ELSE coalesce(nullif(run_id, ''), 'manual__2026-09-29T10:00:00') END AS run_id,
      coalesce(nullif(operator, ''), 'KubernetesPodOperator') AS operator FROM {alerts}""",
)
def _(t):
    return ops.extract_coordinates(t.alerts).select(
        "alert_id", "cluster", "dag_id", "task_id", "run_id", "operator"
    )


@query(
    "chat_coordinates",
    """SELECT conv_id, turn, role AS cluster, 'dag_' || cast(turn AS string) AS dag_id,
         'run_dbt_heavy_aggregation' AS task_id, length(prompt) AS prompt_chars
       FROM (SELECT *, text || ' dag_id=dag_' || cast(turn AS string) || ' on cluster ''' || role || '''' AS prompt
         FROM {conversations}) c""",
)
def _(t):
    prompts = t.conversations.select(
        "conv_id",
        "turn",
        F.concat(
            "text", F.lit(" dag_id=dag_"), F.col("turn").cast("string"),
            F.lit(" on cluster '"), "role", F.lit("'"),
        ).alias("prompt"),
        *[F.lit(None).cast("string").alias(c) for c in ("cluster", "dag_id", "task_id", "run_id", "operator")],
    )
    return ops.extract_coordinates(prompts).select(
        "conv_id", "turn", "cluster", "dag_id", "task_id",
        F.length("prompt").cast("long").alias("prompt_chars"),
    )


@query(
    "build_alert",
    """SELECT event_id, event_type, cluster, dag_id, task_id, run_id, try_number, operator, pod_name, execution_date,
         exception_type, exception_message,
         'Failure on cluster ''' || cluster || ''' in DAG ''' || dag_id || ''' task ''' || task_id || ''' run ''' || run_id
         || '''. Operator ' || operator || ' raised ' || exception_type || ': ' || exception_message AS prompt
       FROM (SELECT event_id, 'AIRFLOW_TASK_FAILED' AS event_type, cluster, pod_name,
           coalesce(dag, CASE WHEN has_ti THEN ti_dag END, 'unknown_dag') AS dag_id,
           CASE WHEN has_ti THEN ti_task ELSE 'unknown_task' END AS task_id,
           coalesce(nullif(run_id, ''), CASE WHEN has_ti THEN ti_run END, 'unknown_run') AS run_id,
           CASE WHEN has_ti THEN ti_try ELSE 1 END AS try_number,
           CASE WHEN has_ti THEN ti_operator ELSE 'UnknownOperator' END AS operator,
           CASE WHEN has_ti THEN coalesce(nullif(execution_date, ''), ti_date) ELSE '' END AS execution_date,
           coalesce(exception_type, 'AirflowException') AS exception_type,
           coalesce(exception_message, 'Task failed with unhandled exception') AS exception_message
         FROM {contexts}) c""",
)
def _(t):
    contexts = t.contexts.withColumn(
        "ti",
        F.when(
            F.col("has_ti"),
            F.struct(
                F.col("ti_dag").alias("dag_id"), F.col("ti_task").alias("task_id"), F.col("ti_run").alias("run_id"),
                F.col("ti_try").alias("try_number"), F.col("ti_operator").alias("operator"),
                F.col("ti_date").alias("execution_date"),
            ),
        ),
    )
    # The run number inside the context keeps the rows apart in the check.
    built = ops.build_alert(contexts.withColumn("pod_name", F.concat_ws("|", "pod_name", "event_id")))
    return built.withColumn("event_id", F.substring_index("pod_name", "|", -1).cast("long")).withColumn(
        "pod_name", F.substring_index("pod_name", "|", 1)
    )


@query(
    "task_instances",
    """SELECT run_id, coalesce(state, 'failed') AS state, coalesce(try_number, 1) AS try_number,
         coalesce(max_tries, 2) AS max_tries, coalesce(operator, 'KubernetesPodOperator') AS operator,
         coalesce(pod_name, 'airflow-worker-' || task_id || '-pod') AS pod_name,
         coalesce(duration_seconds, 0) AS duration_seconds FROM {task_records}""",
)
def _(t):
    return ops.task_instances(t.task_records).drop("task_id")


@query(
    "retry_budget",
    """SELECT cluster, dag_id, task_id, execution_date, count(*) AS n_attempts, max(attempt) AS last_attempt,
         greatest(2 - max(attempt), 0) AS tries_left, max(attempt) > 2 AS auto_blocked
       FROM {task_runs} GROUP BY ALL""",
)
def _(t):
    return ops.retry_budget(t.task_runs)


@query(
    "known_incident",
    """SELECT run_id, coalesce(d.scenario_id, c.scenario_id, 'oom_exit_code_137') AS scenario_id,
         CASE WHEN d.scenario_id IS NOT NULL THEN 'dag' WHEN c.scenario_id IS NOT NULL THEN 'cluster'
           ELSE 'default' END AS matched_by
       FROM {failed_runs} r
       LEFT JOIN (SELECT dag_id, arg_min(scenario_id, ord) AS scenario_id FROM {known_labels} GROUP BY 1) d ON r.dag_id = d.dag_id
       LEFT JOIN (SELECT cluster, arg_min(scenario_id, ord) AS scenario_id FROM {known_labels} GROUP BY 1) c
         ON r.cluster = c.cluster""",
)
def _(t):
    rows = ops.match_known_incident(t.failed_runs, t.known_labels)
    return rows.select("run_id", "scenario_id", "matched_by")


@query(
    "triage_queue",
    """SELECT f.run_id, f.dag_id, coalesce(s.tier, 9) AS tier FROM {failed_runs} f
       LEFT JOIN {service_levels} s ON f.dag_id = s.dag_id ORDER BY coalesce(s.tier, 9), f.ts, f.run_id LIMIT 50""",
)
def _(t):
    return ops.triage_queue(t.failed_runs, t.service_levels, 50).select("run_id", "dag_id", "tier")


@query(
    "triage_queue_per_team",
    """SELECT run_id, team, tier, cast(rank AS int) AS rank FROM (
         SELECT f.run_id, coalesce(s.team, '@oncall') AS team, coalesce(s.tier, 9) AS tier,
           row_number() OVER (PARTITION BY coalesce(s.team, '@oncall') ORDER BY coalesce(s.tier, 9), f.ts, f.run_id) AS rank
         FROM {failed_runs} f LEFT JOIN {service_levels} s ON f.dag_id = s.dag_id) q WHERE rank <= 20""",
)
def _(t):
    rows = ops.triage_queue_per_team(t.failed_runs, t.service_levels, 20)
    return rows.select("run_id", "team", "tier", "rank")


derived.DERIVED["node_hits"] = """
SELECT w.task_id, w.hint, arg_min(n.node_id, n.ord) AS node_id,
  coalesce(arg_min(struct_pack(p := n.original_file_path), n.ord).p, w.hint) AS node_path
FROM (SELECT DISTINCT task_id, nullif(hint, '') AS hint FROM {owned}) w
JOIN {manifest_nodes} n ON contains(n.node_id, w.task_id) OR n.original_file_path = w.hint
GROUP BY w.task_id, w.hint
"""

derived.DERIVED["owned_tiers"] = """
SELECT o.*, nullif(o.hint, '') AS file_hint, h.node_id, h.node_path, g.ord AS tag_ord, c.ord AS cat_ord,
  CASE WHEN git_repo IS NOT NULL THEN 1 WHEN h.node_id IS NOT NULL THEN 2 WHEN g.ord IS NOT NULL THEN 3
    WHEN c.ord IS NOT NULL THEN 4 ELSE 5 END AS tier
FROM {owned} o
LEFT JOIN {node_hits} h ON o.task_id = h.task_id AND nullif(o.hint, '') IS NOT DISTINCT FROM h.hint
LEFT JOIN (SELECT tags, arg_min(c.ord, pos) AS ord
  FROM (SELECT tags, unnest(string_split(tags, ',')) AS tag, generate_subscripts(string_split(tags, ','), 1) AS pos
    FROM (SELECT DISTINCT tags FROM {owned} WHERE tags IS NOT NULL) x) y
  JOIN {catalog_rows} c ON tag = 'repo:' || c.repo_name GROUP BY tags) g ON o.tags = g.tags
LEFT JOIN (SELECT dag, min(ord) AS ord FROM (SELECT unnest(string_split(dags, ',')) AS dag, ord FROM {catalog_rows}) z
  GROUP BY dag) c ON o.dag_id = c.dag
"""


@query("manifest_match", "SELECT task_id, hint, node_id, node_path FROM {node_hits}")
def _(t):
    return ownership.manifest_match(owned(t), t.manifest_nodes)


@query(
    "tag_match",
    """SELECT o.run_id, c.repo_name FROM {owned_tiers} o JOIN {catalog_rows} c ON c.ord = o.tag_ord""",
)
def _(t):
    rows = owned(t)
    return rows.join(ownership.tag_match(rows, catalog(t)), "dag_tags").select("run_id", "tagged.repo_name")


@query(
    "catalog_match",
    """SELECT o.run_id, c.repo_name FROM {owned_tiers} o JOIN {catalog_rows} c ON c.ord = o.cat_ord""",
)
def _(t):
    return owned(t).join(ownership.catalog_match(catalog(t)), "dag_id").select("run_id", "listed.repo_name")


derived.DERIVED["owners"] = """
SELECT run_id, tier,
      CASE tier WHEN 1 THEN 'environment' WHEN 2 THEN 'manifest' WHEN 3 THEN 'dag_tag' WHEN 4 THEN 'catalog' ELSE 'default' END AS discovery_method,
      CASE tier WHEN 1 THEN replace(split_part(git_repo, '/', -1), '.git', '') WHEN 3 THEN g.repo_name WHEN 4 THEN c.repo_name
        ELSE 'analytics-dbt' END AS repo_name,
      CASE tier WHEN 1 THEN git_repo WHEN 3 THEN g.repo_url WHEN 4 THEN c.repo_url ELSE 'https://git.example.com/analytics-dbt' END AS repo_url,
      CASE tier WHEN 1 THEN coalesce(git_branch, 'main') WHEN 3 THEN g.default_branch WHEN 4 THEN c.default_branch ELSE 'main' END AS default_branch,
      CASE tier WHEN 2 THEN node_path WHEN 3 THEN coalesce(file_hint, g.code_subpath)
        WHEN 4 THEN coalesce(file_hint, c.code_subpath || CASE WHEN c.code_subpath = '' OR c.code_subpath LIKE '%/' THEN '' ELSE '/' END || task_id || '.sql')
        ELSE coalesce(file_hint, 'models/' || task_id || '.sql') END AS target_file_path,
      CASE tier WHEN 1 THEN '@data-engineering' WHEN 2 THEN '@analytics-engineering' WHEN 3 THEN g.team_owner WHEN 4 THEN c.team_owner
        ELSE '@oncall-data-sre' END AS team_owner,
      CASE tier WHEN 3 THEN g.slack_channel WHEN 4 THEN c.slack_channel ELSE '#data-platform-alerts' END AS channel,
      CASE tier WHEN 3 THEN g.framework WHEN 4 THEN c.framework END AS framework
    FROM {owned_tiers} o LEFT JOIN {catalog_rows} g ON g.ord = o.tag_ord LEFT JOIN {catalog_rows} c ON c.ord = o.cat_ord
"""


@query("resolve_owner", "SELECT * FROM {owners}")
def _(t):
    return ownership.resolve_owner(owned(t), t.manifest_nodes, catalog(t)).drop(
        "dag_id", "task_id", "env_vars", "dag_tags", "hint"
    )


@query(
    "parse_uri",
    r"""SELECT run_id, regexp_extract(clean, '^([^/]*)', 1) AS bucket, regexp_extract(clean, '^[^/]*/(.*)$', 1) AS key,
         regexp_extract(clean, '/dag_id=([^/]*)', 1) AS dag_id, regexp_extract(clean, '/attempt=([0-9]*)', 1) AS attempt
       FROM (SELECT run_id, 'logs-' || cluster || '/airflow-logs/cluster=' || cluster || '/dag_id=' || dag_id || '/task_id=' || task_id
         || '/execution_date=' || execution_date || '/attempt=' || cast(attempt AS string) || '.log' AS clean FROM {task_runs}) u""",
)
def _(t):
    uri = F.concat(
        F.lit("s3://logs-"), "cluster", F.lit("/airflow-logs/cluster="), "cluster", F.lit("/dag_id="), "dag_id",
        F.lit("/task_id="), "task_id", F.lit("/execution_date="), "execution_date",
        F.lit("/attempt="), F.col("attempt").cast("string"), F.lit(".log"),
    )
    rows = t.task_runs.select("run_id", uri.alias("uri"))
    values = C.key_values(C.uri_key(F.col("uri")))
    return rows.select(
        "run_id",
        C.uri_bucket(F.col("uri")).alias("bucket"),
        C.uri_key(F.col("uri")).alias("key"),
        values["dag_id"].alias("dag_id"),
        F.regexp_extract(values["attempt"], r"^(\d*)", 1).alias("attempt"),
    )


@query(
    "url_parts",
    """SELECT page_id, split_part(url, '/', -1) AS last_segment, replace(split_part(url, '/', -1), '.git', '') AS repo_name,
         substr(html, 1, 800) AS preview FROM {pages}""",
)
def _(t):
    return t.pages.select(
        "page_id",
        C.last_segment(F.col("url")).alias("last_segment"),
        C.repo_from_url(F.col("url")).alias("repo_name"),
        X.preview(F.col("html")).alias("preview"),
    )


derived.DERIVED["log_requests"] = """
SELECT event_id, run_id AS request_id, cluster, dag_id, CASE WHEN event_id % 5 = 0 THEN 'no_such_task' ELSE task_id END AS task_id,
  CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN run_id ELSE 'never' END AS execution_date, attempt FROM {failed_runs}
"""

# Run ids stand in for execution dates here, because a lake holds one log per key.
derived.DERIVED["stored_logs"] = """
SELECT cluster, dag_id, task_id, run_id AS execution_date, attempt, log_text, 'logs/' || run_id AS uri FROM {failed_runs}
"""


@query(
    "lookup_logs",
    """WITH newest AS (SELECT * FROM {stored_logs} QUALIFY row_number() OVER (PARTITION BY cluster, dag_id, task_id
           ORDER BY execution_date DESC, attempt DESC, uri DESC) = 1)
       SELECT r.request_id, coalesce(e.uri, n.uri) AS uri, coalesce(md5(coalesce(e.log_text, n.log_text)), '') AS log_md5,
         coalesce(e.uri, n.uri) IS NOT NULL AS log_found
       FROM {log_requests} r
       LEFT JOIN {stored_logs} e ON r.cluster = e.cluster AND r.dag_id = e.dag_id AND r.task_id = e.task_id
         AND r.execution_date = e.execution_date AND r.attempt = e.attempt
       LEFT JOIN newest n ON r.cluster = n.cluster AND r.dag_id = n.dag_id AND r.task_id = n.task_id""",
)
def _(t):
    rows = log_ops.lookup_logs(t.log_requests, t.stored_logs)
    return rows.select("request_id", "uri", F.coalesce(F.md5("log_text"), F.lit("")).alias("log_md5"), "log_found")


# Alerts with the execution date of their run, with one that never was, and without.
derived.DERIVED["dated_alerts"] = """
SELECT a.alert_id, a.try_number, a.prompt, a.cluster, a.dag_id, a.task_id, a.run_id, a.operator,
  CASE f.event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'never' ELSE f.run_id END AS execution_date
FROM {alerts} a JOIN {failed_runs} f ON a.alert_id = f.run_id
"""


@query(
    "alert_decisions",
    r"""WITH named AS (SELECT alert_id, try_number, execution_date,
           CASE WHEN prompt LIKE '%cluster ''%' THEN regexp_extract(prompt, 'cluster ''([^'']*)', 1)
             WHEN prompt LIKE '%cluster %' THEN trim(split_part(split_part(prompt, 'cluster ', 2), ' ', 1), ''',"')
             ELSE coalesce(nullif(cluster, ''), 'gke-prod-us-central1') END AS cluster,
           CASE WHEN prompt LIKE '%DAG ''%' THEN split_part(split_part(prompt, 'DAG ''', 2), '''', 1)
             WHEN prompt LIKE '%dag_id=%' THEN trim(split_part(split_part(prompt, 'dag_id=', 2), ' ', 1), ''',"')
             ELSE coalesce(nullif(dag_id, ''), 'analytics_daily_etl') END AS dag_id,
           CASE WHEN prompt LIKE '%task ''%' THEN split_part(split_part(prompt, 'task ''', 2), '''', 1)
             WHEN prompt LIKE '%task_id=%' THEN trim(split_part(split_part(prompt, 'task_id=', 2), ' ', 1), ''',"')
             ELSE coalesce(nullif(task_id, ''), 'run_dbt_heavy_aggregation') END AS task_id FROM {dated_alerts}),
         newest AS (SELECT * FROM {decided} QUALIFY row_number() OVER (PARTITION BY cluster, dag_id, task_id
           ORDER BY run_id DESC) = 1),
         found AS (SELECT a.*, coalesce(e.run_id, n.run_id) AS log_of, coalesce(e.failure_category, n.failure_category, 'UNKNOWN') AS failure_category
           FROM named a LEFT JOIN {decided} e ON a.cluster = e.cluster AND a.dag_id = e.dag_id AND a.task_id = e.task_id
             AND a.execution_date = e.run_id AND a.try_number = e.attempt
           LEFT JOIN newest n ON a.cluster = n.cluster AND a.dag_id = n.dag_id AND a.task_id = n.task_id)
       SELECT alert_id, log_of IS NOT NULL AS log_found, failure_category,
         CASE WHEN failure_category = 'STRUCTURAL_SCHEMA_DRIFT' THEN 'approval' WHEN failure_category = 'DEPENDENCY_LAG' THEN 'execute'
           WHEN failure_category NOT IN ('DATA_QUALITY', 'STRUCTURAL_DIVISION_BY_ZERO', 'SILENT_DATA_ANOMALY',
             'STRUCTURAL_SYNTAX', 'TRANSIENT_NETWORK', 'UNKNOWN') AND try_number <= 2 THEN 'execute' ELSE 'report' END AS route
       FROM found""",
)
def _(t):
    rows = flow.alert_decisions(t.dated_alerts, t.stored_logs)
    return rows.select("alert_id", "log_found", "failure_category", "route")
