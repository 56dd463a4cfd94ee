"""Alert parsing and rendering, queues and known incidents."""

import datetime as dt

from faultline.functions import coordinates as C
from faultline.operators import alerts, flow

FIELDS = "prompt string, cluster string, dag_id string, task_id string, run_id string, operator string"


def coordinates(spark, prompt, cluster=None, dag=None, task=None, run=None, operator=None):
    rows = spark.createDataFrame([(prompt, cluster, dag, task, run, operator)], FIELDS)
    r = alerts.extract_coordinates(rows).first()
    return r.cluster, r.dag_id, r.task_id, r.run_id, r.operator


def test_quoted_form_wins_over_bare(spark):
    got = coordinates(spark, "cluster x, cluster 'y' DAG 'd' dag_id=e task 't' run 'r'", "p", "p", "p", "p", "Op")
    assert got == ("y", "d", "t", "r", "Op")


def test_bare_form_is_cut_at_the_space_and_stripped(spark):
    got = coordinates(spark, "on cluster \"c-1\", dag_id='d', task_id=t. next")
    assert got[:3] == ("c-1", "d", "t.")


def test_payload_then_default(spark):
    d = C.DEFAULTS
    assert coordinates(spark, None, "c", "", None, "r") == ("c", d["dag_id"], d["task_id"], "r", d["operator"])
    assert coordinates(spark, "nothing here") == tuple(d.values())


def test_unclosed_quote_takes_the_rest(spark):
    assert coordinates(spark, "DAG 'open ended")[1] == "open ended"


def test_rendered_prompt_parses_back(spark):
    schema = (
        "cluster string, pod_name string, dag string, run_id string, execution_date string, "
        "ti struct<dag_id:string,task_id:string,run_id:string,try_number:int,operator:string,execution_date:string>, "
        "exception_type string, exception_message string"
    )
    rows = spark.createDataFrame(
        [
            ("c", "p", "d", "r", "2026-01-01", ("x", "t", "tr", 2, "Op", "tid"), "ValueError", "bad"),
            ("c", None, None, "", None, ("x", "t", "tr", 2, "Op", "tid"), None, None),
            ("c", None, None, None, "2026-01-01", None, None, None),
        ],
        schema,
    )
    built = alerts.build_alert(rows)
    got = [(r.dag_id, r.task_id, r.run_id, r.try_number, r.execution_date) for r in built.collect()]
    assert got == [
        ("d", "t", "r", 2, "2026-01-01"), ("x", "t", "tr", 2, "tid"), ("unknown_dag", "unknown_task", "unknown_run", 1, ""),
    ]
    blank = built.select(
        "prompt", *[C.F.lit("").alias(c) for c in ("cluster", "dag_id", "task_id", "run_id", "operator")]
    )
    back = [(r.cluster, r.dag_id, r.task_id, r.run_id) for r in alerts.extract_coordinates(blank).collect()]
    assert back == [("c", "d", "t", "r"), ("c", "x", "t", "tr"), ("c", "unknown_dag", "unknown_task", "unknown_run")]


def test_queue_orders_by_tier_then_age(spark):
    t0 = dt.datetime(2024, 1, 1)
    incidents = spark.createDataFrame(
        [("r1", "d3", t0), ("r2", "d1", t0 + dt.timedelta(1)), ("r3", "d1", t0), ("r4", "zz", t0 - dt.timedelta(9))],
        "run_id string, dag_id string, ts timestamp",
    )
    sla = spark.createDataFrame([("d1", 1, "a"), ("d3", 3, "a")], "dag_id string, tier int, team string")
    assert [r.run_id for r in alerts.triage_queue(incidents, sla, 3).collect()] == ["r3", "r2", "r1"]
    ranked = alerts.triage_queue_per_team(incidents, sla, 2).collect()
    assert {(r.team, r.run_id, r.rank) for r in ranked} == {("a", "r3", 1), ("a", "r2", 2), ("@oncall", "r4", 1)}


def test_quantities(spark):
    rows = spark.createDataFrame([("2048Mi", "2h"), ("50Gi", "30m"), ("x", "10s"), (None, None)], "m string, d string")
    got = rows.select(C.memory_mib(C.F.col("m")).alias("m"), C.duration_seconds(C.F.col("d")).alias("d")).collect()
    assert [tuple(r) for r in got] == [(2048, 7200), (51200, 1800), (None, 10), (None, None)]


def test_alert_without_log_is_reported(spark):
    rows = spark.createDataFrame(
        [("cluster 'c' DAG 'd' task 't'", 1, None), ("cluster 'c' DAG 'd' task 'other'", 1, None)],
        "prompt string, try_number int, execution_date string",
    ).selectExpr("*", *[f"cast(null AS string) AS {c}" for c in ("cluster", "dag_id", "task_id", "run_id", "operator")])
    logs = spark.createDataFrame(
        [("c", "d", "t", "2024-01-01", 1, "deadlockdetected", "u1"), ("c", "d", "t", "2024-01-02", 10, "oomkilled", "u2"),
         ("c", "d", "t", "2024-01-02", 9, "429", "u3")],
        "cluster string, dag_id string, task_id string, execution_date string, attempt int, log_text string, uri string",
    )
    got = {r.task_id: (r.failure_category, r.route) for r in flow.alert_decisions(rows, logs).collect()}
    assert got == {"t": ("TRANSIENT_OOM", "execute"), "other": ("UNKNOWN", "report")}
