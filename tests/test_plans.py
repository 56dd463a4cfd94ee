"""Plans that must hold at scale, and the driver contract."""

import io
import os
import re
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry
from faultline.operators import triage
from faultline.plans import QUERIES
from faultline.plans.registry import Tables

ROOT = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")

# The queries that need Python: stateful counts, opened objects, differences of any two texts.
PYTHON = {"stream_retry_budget", "stream_approval_states", "lookup_objects", "objects_at_keys", "file_diffs"}
WRITES = {n for n in QUERIES if n.startswith(("stream_", "scan_", "lake_", "list_"))} | {
    "lineage_closure", "blast_radius", "catalog_file", "incident_timeline"
}


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0
    assert "failure_category" in rows.columns


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_plan_has_no_pair_joins_or_python(spark, name):
    text = plan(entry.queries()[name](spark, ROOT))
    assert "CartesianProduct" not in text
    assert "NestedLoopJoin" not in text
    if name not in PYTHON:
        assert not re.search("EvalPython|InPandas|InArrow|InPython", text)


@needs_data
def test_decisions_are_one_stage_with_pushdown(spark):
    t = Tables(spark, ROOT)
    text = plan(triage.route_incidents(triage.evaluate_policy(triage.classify_failures(t.failed_runs))))
    assert "Exchange" not in text
    assert "EqualTo(event_type,error)" in text
    assert "props" not in text.split("ReadSchema")[1]


@needs_data
def test_filter_on_category_does_not_repeat_the_rules(spark):
    t = Tables(spark, ROOT)
    text = plan(triage.classify_failures(t.failed_runs).where("failure_category = 'UNKNOWN'"))
    assert text.count("terminatedbypreemption") == 1


@needs_data
def test_rank_limits_run_before_the_shuffle(spark):
    for name in ("triage_queue_per_team", "pod_events_each"):
        text = plan(entry.queries()[name](spark, ROOT))
        assert "WindowGroupLimit" in text and "Partial" in text


@needs_data
def test_texts_do_not_move_with_their_index(spark):
    t = Tables(spark, ROOT)
    stored = f"{ROOT}/../sf0.001/documents.parquet"
    logs = spark.read.parquet(stored).selectExpr(
        "lang AS cluster", "source AS dag_id", "'t' AS task_id", "cast(doc_id AS string) AS execution_date",
        "1 AS attempt", "cast(doc_id AS string) AS uri", "text AS log_text",
    )
    from faultline.operators import logs as log_ops

    newest = plan(log_ops.latest_attempt(logs, log_ops.TASK_KEY, log_ops.LOG_ORDER))
    found = plan(log_ops.lookup_logs(logs.drop("uri", "log_text"), logs))
    # No sort or shuffle holds a text but behind the join that picks the wanted ones.
    assert "BroadcastHashJoin" in newest and "Window" not in newest
    assert t.spark is spark and "CartesianProduct" not in found


@needs_data
def test_building_owners_runs_no_job(spark):
    from faultline.operators import ownership
    from faultline.plans import alerts

    t = Tables(spark, ROOT)
    inputs = alerts.owned(t).repartition(3, "run_id"), t.manifest_nodes.repartition(3), alerts.catalog(t)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("owners", "owners")
    ownership.resolve_owner(*inputs)
    assert list(tracker.getJobIdsForGroup("owners")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
