"""Queries that write a lake from the tables and read it back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import ownership
from faultline.plans import alerts, code, telemetry  # noqa: F401  (derived relations)
from faultline.plans.registry import query
from faultline.session import scratch_dir
from faultline.sources import lake, objects

def _month():
    return F.concat(F.substring(F.col("ts").cast("string"), 1, 7), F.lit("-01"))


def _day():
    return F.substring(F.col("ts").cast("string"), 1, 10)


def _log_lake(t) -> str:
    root = scratch_dir(t.spark, "airflow-logs")
    logs = t.task_runs.select(
        F.col("log_text").alias("value"), "cluster", "dag_id", "task_id", _month().alias("execution_date"), "attempt"
    )
    lake.write_lake(logs, root, ["cluster", "dag_id", "task_id", "execution_date", "attempt"], "text")
    return root


# Files may hold several logs in any order, so their lines are compared as a whole.
def _lines(rows, keys: list[str], text: str):
    return rows.select(*keys, F.explode(F.split(text, "\n")).alias("line")).where("line <> ''").groupBy(*keys).agg(
        F.count("*").alias("n_lines"), F.count_distinct("line").alias("n_different"),
        F.md5(F.min("line")).alias("first_md5"), F.md5(F.max("line")).alias("last_md5"),
    )


LINES = """SELECT {keys}, count(*) AS n_lines, count(DISTINCT line) AS n_different, md5(min(line)) AS first_md5, md5(max(line)) AS last_md5
  FROM (SELECT {named}, unnest(string_split({text}, chr(10))) AS line FROM {rel}) l WHERE line <> '' GROUP BY ALL"""


@query(
    "scan_task_logs",
    LINES.replace("{keys}", "cluster, dag_id, task_id, execution_date, attempt")
    .replace("{named}", "cluster, dag_id, task_id, substr(cast(ts AS string), 1, 7) || '-01' AS execution_date, attempt")
    .replace("{text}", "log_text").replace("{rel}", "{task_runs}"),
)
def _(t):
    logs = lake.scan_task_logs(t.spark, _log_lake(t))
    return _lines(logs, ["cluster", "dag_id", "task_id", "execution_date", "attempt"], "log_text")


@query(
    "lake_inventory",
    """SELECT cluster AS part, cast(sum(strlen(log_text) + 1) AS bigint) AS n_bytes, true AS has_objects
       FROM {task_runs} GROUP BY cluster""",
)
def _(t):
    listed = lake.objects(t.spark, _log_lake(t)).where("path LIKE '%.txt'")
    part = F.regexp_extract("path", "cluster=([^/]+)", 1)
    return lake.inventory(listed, part).select("part", "n_bytes", (F.col("n_objects") > 0).alias("has_objects"))


@query(
    "list_objects",
    """SELECT DISTINCT 'cluster=' || cluster || '/dag_id=' || dag_id || '/day=' || substr(cast(ts AS string), 1, 10) AS folder FROM {task_runs}
       WHERE cluster = 'us-prod-1' AND starts_with(dag_id, 'db')""",
)
def _(t):
    root = scratch_dir(t.spark, "listing")
    rows = t.task_runs.select("run_id", "cluster", "dag_id", _day().alias("day"))
    lake.write_lake(rows, root, ["cluster", "dag_id", "day"], "json")
    # Half a name as the prefix; the limit lies above the number of objects here.
    listed = lake.list_objects(t.spark, root, "cluster=us-prod-1/dag_id=db", max_keys=1_000_000)
    return listed.select(F.regexp_extract("key", "^(.*)/[^/]+$", 1).alias("folder")).distinct()


@query(
    "catalog_file",
    """SELECT o.run_id, c.repo_name, c.team_owner, c.framework FROM {owned} o
       JOIN (SELECT unnest(string_split(dags, ',')) AS dag, arg_min(repo_name, ord) AS repo_name, arg_min(team_owner, ord) AS team_owner,
           arg_min(framework, ord) AS framework
         FROM (SELECT ord, dags, repo_name, team_owner, framework FROM {catalog_rows}) r GROUP BY dag) c ON o.dag_id = c.dag""".replace(
        "unnest(string_split(dags, ',')) AS dag, arg_min", "dag, arg_min"
    ).replace("FROM (SELECT ord, dags, repo_name", "FROM (SELECT ord, unnest(string_split(dags, ',')) AS dag, repo_name"),
)
def _(t):
    # The catalog as the one JSON file it is kept in, then read like any other.
    path = scratch_dir(t.spark, "catalog")
    rows = t.catalog_rows.withColumn("matching_dags", F.split("dags", ","))
    fields = ["repo_name", "repo_url", "default_branch", "code_subpath", "team_owner", "slack_channel", "matching_dags", "framework"]
    entries = F.sort_array(F.collect_list(F.struct("ord", "repo_name", F.struct(*fields).alias("entry"))))
    keyed = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["repo_name"], e["entry"])))
    rows.agg(keyed.alias("repositories")).coalesce(1).write.json(path)
    catalog = lake.load_service_catalog(t.spark, path)
    found = t.owned.join(ownership.catalog_match(catalog), "dag_id")
    return found.select("run_id", "listed.repo_name", "listed.team_owner", "listed.framework")


@query(
    "result_bundle",
    """SELECT r.run_id, f.repo, f.file_path, md5(f.content) AS content_md5
       FROM (SELECT run_id, event_id % 500 AS no FROM {task_runs}) r LEFT JOIN {repo_files} f ON f.doc_id = r.no""",
)
def _(t):
    number = F.concat(F.lit("model.finance.q_"), (F.col("event_id") % 500).cast("string"))
    bundle = lake.result_bundle(t.task_runs.select("run_id", number.alias("unique_id")), t.repo_files)
    return bundle.select("run_id", "repo", "file_path", F.md5("content").alias("content_md5"))


@query(
    "lake_roundtrip",
    """SELECT cluster, dag_id, count(*) AS n, cast(sum(cast(value AS decimal(18,2))) AS double) AS total,
         min(run_id) AS first_run, max(log_text) AS last_text FROM {task_runs} GROUP BY ALL""",
)
def _(t):
    root = scratch_dir(t.spark, "roundtrip")
    lake.write_lake(t.task_runs, root, ["cluster", "dag_id"])
    rows = t.spark.read.parquet(root)
    return rows.groupBy("cluster", "dag_id").agg(
        F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"),
        F.min("run_id").alias("first_run"), F.max("log_text").alias("last_text"),
    )


@query(
    "scan_cloud_events",
    """SELECT insert_id, cluster, severity, resource_type, pod_name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at,
         substr(cast(ts AS string), 9, 2) AS day FROM {cloud_events}""",
)
def _(t):
    root = scratch_dir(t.spark, "cloud-logging")
    date = F.col("ts").cast("string")
    events = t.cloud_events.select(
        F.col("insert_id").alias("insertId"),
        F.concat(F.replace(F.substring(date, 1, 19), F.lit(" "), F.lit("T")), F.lit("Z")).alias("timestamp"),
        "severity",
        F.struct(F.col("resource_type").alias("type"), F.create_map(F.lit("cluster_name"), "cluster").alias("labels")).alias("resource"),
        F.create_map(F.lit("pod_name"), "pod_name", F.lit("exit_code"), F.lit("0")).alias("jsonPayload"),
        "cluster", F.substring(date, 1, 4).alias("year"), F.substring(date, 6, 2).alias("month"), F.substring(date, 9, 2).alias("day"),
    )
    lake.write_lake(events, root, ["cluster", "year", "month", "day"], "json")
    rows = lake.scan_cloud_events(t.spark, root, lines=True)
    return rows.select(
        "insert_id", "cluster", "severity", "resource_type", F.col("payload")["pod_name"].alias("pod_name"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "day",
    )


@query(
    "scan_metrics",
    """SELECT cluster, metric, pod_name, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at, round(value, 4) AS value FROM {metrics}""",
)
def _(t):
    root = scratch_dir(t.spark, "grafana-metrics")
    series = F.struct(
        F.create_map(F.lit("__name__"), "metric", F.lit("pod"), "pod_name").alias("metric"),
        F.array(F.array(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.col("value").cast("string"))).alias("values"),
    )
    docs = t.metrics.select(
        F.lit("success").alias("status"), F.struct(F.lit("matrix").alias("resultType"), F.array(series).alias("result")).alias("data"),
        "cluster", F.col("metric").alias("metric"),
    )
    lake.write_lake(docs, root, ["cluster", "metric"], "json")
    rows = lake.scan_metrics(t.spark, root, lines=True)
    return rows.select(
        "cluster", "metric", F.col("labels")["pod"].alias("pod_name"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.round("value", 4).alias("value"),
    )


@query(
    "scan_manifest",
    """SELECT 'model.' || name AS node_id, name, len(string_split(declared, ',')) AS n_columns, length(raw_code) AS code_chars
       FROM {model_nodes} WHERE declared IS NOT NULL""",
)
def _(t):
    root = scratch_dir(t.spark, "dbt-artifacts")
    column_type = "map<string,struct<name:string,data_type:string>>"
    columns = F.map_from_entries(
        F.transform(
            F.split("declared", ","),
            lambda c: F.struct(c, F.struct(c.alias("name"), F.lit("string").alias("data_type"))),
        )
    ).cast(column_type)
    node = F.struct(
        "name", F.lit("model").alias("resource_type"), "raw_code", columns.alias("columns"),
        F.struct(F.array(F.lit("model.m_0")).alias("nodes")).alias("depends_on"),
    )
    docs = t.model_nodes.where("declared IS NOT NULL").select(
        F.map_from_arrays(F.array(F.concat(F.lit("model."), "name")), F.array(node)).alias("nodes"),
        F.lit("finance").alias("project"), F.lit("r1").alias("run_id"),
    )
    lake.write_lake(docs, root, ["project", "run_id"], "json")
    rows = lake.scan_manifest(t.spark, root, lines=True)
    return rows.select(
        "node_id", "name", F.size("columns").cast("long").alias("n_columns"), F.length("raw_code").cast("long").alias("code_chars")
    )


@query(
    "scan_run_results",
    """SELECT 'model.' || run_id AS unique_id, project, status, coalesce(code, '') AS code, value AS seconds FROM {results}""",
)
def _(t):
    root = scratch_dir(t.spark, "dbt-results")
    result = F.struct(
        "status", F.array(F.struct(F.lit("execute").alias("name"), F.col("value").alias("duration"))).alias("timing"),
        F.concat(F.lit("model."), "run_id").alias("unique_id"), "message", F.struct("code").alias("adapter_response"),
    )
    docs = t.results.select(F.array(result).alias("results"), "project", F.lit("r1").alias("run_id"))
    lake.write_lake(docs, root, ["project", "run_id"], "json")
    rows = lake.scan_run_results(t.spark, root, lines=True)
    return rows.select(
        "unique_id", "project", "status", F.coalesce("code", F.lit("")).alias("code"),
        F.get("timing.duration", F.lit(0)).alias("seconds"),
    )


@query(
    "bad_json_rows",
    """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'Invalid JSON' END AS error,
         CASE WHEN event_id % 11 = 0 THEN substr(props, 1, 5) END AS raw,
         CASE WHEN event_id % 11 <> 0 THEN props ->> 'k' END AS k FROM {events}""",
)
def _(t):
    text = F.when(F.col("event_id") % 11 == 0, F.substring("props", 1, 5)).otherwise(F.col("props"))
    rows = lake.parse_json(t.events.select("event_id", text.alias("doc")), "doc", "k string")
    return rows.select("event_id", "error", "raw", F.col("parsed.k").alias("k"))


@query("utf8_repair", "SELECT doc_id, text || chr(65533) || 'end' AS text FROM {documents}")
def _(t):
    broken = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")), F.encode(F.lit("end"), "UTF-8"))
    return lake.decode_text(t.documents.select("doc_id", broken.alias("raw")), "raw", "text").select("doc_id", "text")


@query(
    "attempt_log_found",
    """SELECT run_id, event_id % 3 = 0 AS log_found FROM {task_runs}""",
)
def _(t):
    runs = t.task_runs.withColumn("execution_date", F.col("run_id"))
    logs = runs.where("event_id % 3 = 0").select("cluster", "dag_id", "task_id", "execution_date", "attempt", "log_text")
    return lake.with_attempt_log(runs.drop("log_text"), logs).select("run_id", "log_found")


@query(
    "scan_repo_files",
    LINES.replace("{keys}", "repo, file_path").replace("{named}", "source AS repo, 'kind=a+b ' || lang AS file_path")
    .replace("{text}", "text").replace("{rel}", "{documents}"),
)
def _(t):
    root = scratch_dir(t.spark, "git-repos")
    # Folders whose names readers report percent-encoded.
    rows = t.documents.select(
        F.col("text").alias("value"), F.col("source").alias("repo"), F.concat(F.lit("a+b "), "lang").alias("kind")
    )
    lake.write_lake(rows, root, ["repo", "kind"], "text")
    files = lake.scan_repo_files(t.spark, root, "*.txt")
    folder = F.substring_index("file_path", "/", 1).alias("file_path")
    named = files.select(F.substring_index("repo", "=", -1).alias("repo"), folder, "content")
    return _lines(named, ["repo", "file_path"], "content")


@query(
    "scan_alerts",
    """SELECT run_id, cluster, attempt AS try_number, operator, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS received_at FROM {failed_runs}""",
)
def _(t):
    path = scratch_dir(t.spark, "alerts")
    rows = t.failed_runs.select(
        F.lit("AIRFLOW_TASK_FAILED").alias("event_type"), "cluster", "dag_id", "task_id", "run_id",
        F.col("attempt").alias("try_number"), "operator", "execution_date", F.col("ts").cast("timestamp").alias("received_at"),
    )
    rows.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    got = lake.scan_alerts(t.spark, path)
    return got.select(
        "run_id", "cluster", "try_number", "operator", F.date_format("received_at", telemetry.FORMAT).alias("received_at")
    )


# Attempt logs as objects, each at the key of its address.
def _object_lake(t) -> str:
    root = scratch_dir(t.spark, "objects")
    logs = t.failed_runs.withColumn("key", objects.log_key("cluster", "dag_id", "task_id", "run_id", "attempt"))
    objects.write_objects(logs.select("key", F.col("log_text").alias("content")), root)
    return root


@query(
    "objects_at_keys",
    """SELECT 'cluster=' || cluster || '/dag_id=' || dag_id || '/task_id=' || task_id || '/execution_date=' || run_id
         || '/attempt=' || cast(attempt AS string) || '.log' AS key, md5(log_text) AS text_md5, attempt
       FROM {failed_runs} WHERE cluster IN ('eu-analytics-1', 'apac-data-1') AND task_id = 'task_1'""",
)
def _(t):
    """Objects written at their keys, synced again, and read by filters on the keys."""
    root = _object_lake(t)
    logs = t.failed_runs.withColumn("key", objects.log_key("cluster", "dag_id", "task_id", "run_id", "attempt"))
    objects.write_objects(logs.select("key", F.col("log_text").alias("content")), root, changed_only=True)
    found = objects.read_logs(t.spark, root).where(
        F.col("cluster").isin("eu-analytics-1", "apac-data-1") & (F.col("task_id") == "task_1")
    )
    return found.select(F.substring_index("uri", "/", -5).alias("key"), F.md5("log_text").alias("text_md5"), "attempt")


@query(
    "lookup_objects",
    """WITH newest AS (SELECT cluster, dag_id, task_id, max(struct_pack(run_id := run_id, attempt := attempt, log_text := log_text)) AS n
         FROM {failed_runs} GROUP BY ALL)
       SELECT r.run_id, CASE WHEN f.run_id IS NOT NULL THEN f.run_id ELSE n.run_id END AS found_run,
         md5(CASE WHEN f.run_id IS NOT NULL THEN f.log_text ELSE n.log_text END) AS text_md5, f.run_id IS NOT NULL OR n IS NOT NULL AS log_found
       FROM {task_runs} r LEFT JOIN {failed_runs} f ON f.run_id = r.run_id
       LEFT JOIN newest w ON w.cluster = r.cluster AND w.dag_id = r.dag_id AND w.task_id = r.task_id""",
)
def _(t):
    """The log of every attempt, by its key; attempts that did not fail get the newest failure of their task."""
    asked = t.task_runs.select("run_id", "cluster", "dag_id", "task_id", F.col("run_id").alias("execution_date"), "attempt")
    rows = objects.lookup_objects(asked, _object_lake(t))
    found = F.regexp_extract("uri", "/execution_date=([^/]+)/", 1)
    return rows.select(
        "run_id", F.when(F.col("log_found"), found).alias("found_run"), F.md5("log_text").alias("text_md5"), "log_found"
    )
