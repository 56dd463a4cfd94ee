"""Readers over small lakes of our own, written in the lake's layout."""

import json
import os

from pyspark.sql import functions as F

from faultline.operators import logs as log_ops
from faultline.operators import ownership, quality, telemetry
from faultline.sources import lake
from faultline.streaming.alerts import drain


def put(root, key, content):
    path = os.path.join(root, key)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())


def log_key(cluster, dag, task, date, attempt):
    return f"cluster={cluster}/dag_id={dag}/task_id={task}/execution_date={date}/attempt={attempt}.log"


def test_task_logs(spark, tmp_path):
    root = str(tmp_path / "airflow-logs")
    date = "2031-02-17T10:00:00+00:00"
    for attempt in (9, 10):
        put(root, log_key("c1", "d", "t", date, attempt), f"line 1\nattempt {attempt}\n")
    put(root, log_key("c1", "d", "t", "2031-02-16T10:00:00+00:00", 3), "older")
    put(root, log_key("c2", "d", "u", date, 1), b"bad \xff byte")
    logs = lake.scan_task_logs(spark, root)
    assert logs.count() == 4
    assert dict(logs.dtypes)["execution_date"] == "string" and dict(logs.dtypes)["attempt"] == "int"
    newest = log_ops.latest_attempt(logs, log_ops.TASK_KEY, log_ops.LOG_ORDER)
    got = {(r.cluster, r.task_id): (r.attempt, r.log_text) for r in newest.collect()}
    assert got[("c1", "t")] == (10, "line 1\nattempt 10\n")
    assert got[("c2", "u")][1] == "bad � byte"
    plan = logs.where("cluster = 'c1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster" in plan

    streamed = drain(lake.stream_task_logs(spark, root), str(tmp_path / "o"), str(tmp_path / "s"))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, logs.collect()))

    requests = spark.createDataFrame(
        [(1, "c1", "d", "t", date, 9), (2, "c1", "d", "t", None, None), (3, "c1", "d", "t", date, 77), (4, "c9", "d", "t", date, 1)],
        "id int, cluster string, dag_id string, task_id string, execution_date string, attempt int",
    )
    found = {r.id: r for r in log_ops.lookup_logs(requests, logs).collect()}
    assert found[1].log_text.endswith("attempt 9\n")
    assert found[2].log_text.endswith("attempt 10\n") and found[3].log_text.endswith("attempt 10\n")
    assert found[4].log_found is False and found[4].log_text is None


def test_cloud_events(spark, tmp_path):
    root = str(tmp_path / "cloud-logging")
    day = "cluster=c1/year=2031/month=02/day=17"
    container = [
        {"insertId": f"i{i}", "timestamp": f"2031-02-17T10:0{i}:00Z", "severity": "CRITICAL" if i == 2 else "INFO",
         "resource": {"type": "k8s_container", "labels": {"cluster_name": "c1"}},
         "jsonPayload": {"pod_name": "p", "exit_code": 137 if i == 2 else 0}}
        for i in range(3)
    ]
    put(root, f"{day}/container.json", json.dumps(container, indent=2))
    wait = [{"timestamp": "2031-02-17T10:31:24+00:00", "severity": "ERROR",
             "jsonPayload": {"error_code": "40P01", "process_id": 41207, "blocked_by": 41233}}]
    put(root, f"{day}/locks.json", json.dumps(wait))
    put(root, f"{day}/broken.json", "{not json")
    events = lake.scan_cloud_events(spark, root)
    good = events.where("corrupt IS NULL")
    assert good.count() == 4 and events.where("corrupt IS NOT NULL").count() == 1
    assert good.first().month == "02"
    assert good.where("ts IS NULL").count() == 0
    crash = good.where("severity = 'CRITICAL'").first()
    assert crash.payload["exit_code"] == "137" and crash.insert_id == "i2"
    lock = good.where("payload['error_code'] = '40P01'").first()
    assert lock.payload["blocked_by"] == "41233" and lock.resource_type is None
    flat = good.withColumn("pod_name", F.col("payload")["pod_name"])
    assert [r.insert_id for r in telemetry.pod_events(flat, "p", "severity = 'INFO'").collect()] == ["i1", "i0"]


def test_metrics(spark, tmp_path):
    root = str(tmp_path / "grafana-metrics")
    doc = {"status": "success", "data": {"resultType": "matrix", "result": [
        {"metric": {"__name__": "memory_bytes", "pod": "p"}, "values": [[1712345600, "10"], [1712345630, "12.5"], [1712345660, "n/a"]]},
        {"metric": {"__name__": "memory_limit", "pod": "p"}, "values": [[1712345600, "20"]]}]}}
    put(root, "cluster=c1/metric=memory/a.json", json.dumps(doc))
    rows = lake.scan_metrics(spark, root)
    assert rows.count() == 4
    values = [(r.raw_value, r.value) for r in rows.where("labels['__name__'] = 'memory_bytes'").orderBy("ts").collect()]
    assert values == [("10", 10.0), ("12.5", 12.5), ("n/a", None)]
    assert lake.scan_metrics(spark, root, "memory").count() == 4
    assert lake.scan_metrics(spark, root, "memory_bytes").count() == 3
    assert rows.orderBy("ts").select(F.unix_seconds("ts")).first()[0] == 1712345600


def test_artifacts_and_bundle(spark, tmp_path):
    root = str(tmp_path / "dbt-artifacts")
    run = "project=finance/run_id=scheduled__2031-02-17T11:00:00"
    manifest = {"metadata": {"project_name": "dw"}, "nodes": {
        "model.a.fct": {"name": "fct", "resource_type": "model", "depends_on": {"nodes": ["model.a.stg"]}, "raw_code": "x",
                        "columns": {"id": {"name": "id", "data_type": "string"}}},
        "model.a.stg": {"name": "stg", "resource_type": "model", "raw_code": "y"}}}
    put(root, f"{run}/manifest.json", json.dumps(manifest, indent=1))
    results = {"metadata": {}, "results": [
        {"status": "error", "timing": [{"name": "execute", "duration": 2.5}], "thread_id": "T", "unique_id": "model.a.fct",
         "message": "Database Error in model fct (models/marts/fct.sql)\n  boom", "adapter_response": {"code": "42703", "rows_affected": 0}}]}
    put(root, f"{run}/run_results.json", json.dumps(results))
    nodes = lake.scan_manifest(spark, root)
    assert {(r.node_id, r.ord, r.run_id) for r in nodes.collect()} == {
        ("model.a.fct", 0, "scheduled__2031-02-17T11:00:00"), ("model.a.stg", 1, "scheduled__2031-02-17T11:00:00")}
    assert [tuple(r) for r in lake.manifest_edges(nodes).collect()] == [("model.a.fct", "model.a.stg")]
    rows = lake.scan_run_results(spark, root)
    assert quality.failing_file(rows).first().failing_file == "models/marts/fct.sql"
    summary = quality.dbt_run_summary(rows, ["project"]).first()
    assert (summary.n_error, summary.execute_seconds, summary.error_codes) == (1, 2.5, "42703")

    repo = str(tmp_path / "git-repos")
    put(repo, "dw/models/marts/fct.sql", "select 1\nfrom t\n")
    put(repo, "dw/README.md", "no")
    files = lake.scan_repo_files(spark, repo)
    assert [tuple(r) for r in files.collect()] == [("dw", "models/marts/fct.sql", "select 1\nfrom t\n")]
    bundle = lake.result_bundle(rows, files).first()
    assert bundle.content == "select 1\nfrom t\n" and bundle.code == "42703"


CATALOG = {"version": "1", "repositories": {
    "b-repo": {"repo_name": "b-repo", "repo_url": "u/b", "default_branch": "rel", "code_subpath": "q", "team_owner": "@b",
               "slack_channel": "#b", "matching_dags": ["d1", "d2"], "framework": "custom-sql"},
    "a-repo": {"repo_name": "a-repo", "repo_url": "u/a", "code_subpath": "models/", "matching_dags": ["d2", "d3"]}}}


def test_catalog_and_owners(spark, tmp_path):
    path = str(tmp_path / "catalog.json")
    put(str(tmp_path), "catalog.json", json.dumps(CATALOG))
    catalog = lake.load_service_catalog(spark, path)
    assert [(r.ord, r.repo_name) for r in catalog.orderBy("ord").collect()] == [(0, "b-repo"), (1, "a-repo")]
    empty = lake.load_service_catalog(spark, str(tmp_path / "absent.json"))
    assert empty.count() == 0 and empty.columns == catalog.columns

    nodes = spark.createDataFrame(
        [(0, "model.x.load_ab", "m/first.sql"), (1, "model.x.load_a", None), (2, "model.x.other", "m/hinted.sql")],
        "ord int, node_id string, original_file_path string",
    )
    tasks = spark.createDataFrame(
        [
            ("env", "d1", "load_a", {"GIT_SYNC_REPO": "https://g/x/team.git"}, None, None),
            ("branch", "d1", "zz", {"GIT_SYNC_REPO": "https://g/x/team.git", "GIT_SYNC_BRANCH": "dev"}, None, "h.sql"),
            ("node", "d1", "load_a", {}, ["repo:a-repo"], None),
            ("hint", "d1", "zz", None, None, "m/hinted.sql"),
            ("tag", "d1", "zz", {}, ["x", "repo:none", "repo:a-repo", "repo:b-repo"], ""),
            ("cat", "d2", "zz", {}, ["repo:none"], None),
            ("cat2", "d3", "zz", {}, [], "f.sql"),
            ("none", "d9", "zz", {}, None, None),
        ],
        "name string, dag_id string, task_id string, env_vars map<string,string>, dag_tags array<string>, hint string",
    )
    rows = ownership.resolve_owner(tasks, nodes, catalog)
    assert rows.count() == tasks.count()
    got = {r.name: (r.tier, r.repo_name, r.default_branch, r.target_file_path) for r in rows.collect()}
    assert got == {
        "env": (1, "team", "main", "models/load_a.sql"),
        "branch": (1, "team", "dev", "h.sql"),
        "node": (2, "analytics-dbt", "main", "m/first.sql"),
        "hint": (2, "analytics-dbt", "main", "m/hinted.sql"),
        "tag": (3, "a-repo", "main", "models/"),
        "cat": (4, "b-repo", "rel", "q/zz.sql"),
        "cat2": (4, "a-repo", "main", "f.sql"),
        "none": (5, "analytics-dbt", "main", "models/zz.sql"),
    }
    assert ownership.resolve_owner(tasks, nodes, empty).where("tier IN (3, 4)").count() == 0


def test_listing_and_inventory(spark, tmp_path):
    root = str(tmp_path / "lake")
    for i in range(5):
        put(root, f"a/cluster=c{i % 2}/f{i}.log", "x" * (i + 1))
    put(root, "b/other.json", "[]")
    listed = lake.list_objects(spark, root, "a/", max_keys=3)
    assert [r.path.rsplit("/", 1)[1] for r in listed.collect()] == ["f0.log", "f2.log", "f4.log"]
    totals = lake.inventory(lake.objects(spark, root), F.regexp_extract("path", "/lake/([^/]+)/", 1))
    assert {(r.part, r.n_objects, r.n_bytes) for r in totals.collect()} == {("a", 5, 15), ("b", 1, 2)}


def test_writer_replaces_only_touched_folders(spark, tmp_path):
    root = str(tmp_path / "out")
    first = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    lake.write_lake(first, root, ["k"])
    lake.write_lake(spark.createDataFrame([("b", 3)], "k string, v int"), root, ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(root).collect()} == {("a", 1), ("b", 3)}


def test_bad_json_keeps_the_text(spark):
    rows = spark.createDataFrame([('{"k": 1}',), ("{oops",), (None,)], "doc string")
    got = [(r.parsed.k if r.parsed else None, r.error, r.raw) for r in lake.parse_json(rows, "doc", "k int").collect()]
    assert got == [(1, None, None), (None, "Invalid JSON", "{oops"), (None, "Invalid JSON", None)]
