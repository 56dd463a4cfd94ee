"""Classification, idempotency and policy against their tables."""

import pytest
from pyspark.sql import functions as F

from faultline.functions.policy import PolicyLimits
from faultline.functions.signatures import CATEGORIES, SIGNATURES
from faultline.functions.sql import register_functions
from faultline.operators import triage

LOGS = [
    ("return code 137. Container was OOMKilled by the cgroup", "TRANSIENT_OOM"),
    ("ended with Exit Code 137", "TRANSIENT_OOM"),
    ("JVM: Out Of Memory", "TRANSIENT_OOM"),
    ("node got a preemption notice", "TRANSIENT_SPOT_PREEMPTION"),
    ("Reason: TerminatedByPreemption", "TRANSIENT_SPOT_PREEMPTION"),
    ("[Errno 28] No space left on device", "TRANSIENT_DISK_FULL"),
    ("evicted: ephemeral-storage usage", "TRANSIENT_DISK_FULL"),
    ("canceling statement due to statement timeout", "TRANSIENT_STATEMENT_TIMEOUT"),
    ("remaining connection slots are reserved", "TRANSIENT_CONNECTION_POOL"),
    ("(RequestTimeTooSkewed) when calling", "TRANSIENT_CLOCK_SKEW"),
    ("ERROR: division by zero in statement: a / b", "STRUCTURAL_DIVISION_BY_ZERO"),
    ("contract violated: ZERO_ROWS_DELIVERED", "SILENT_DATA_ANOMALY"),
    ("errors.DeadlockDetected: deadlock detected (ERROR: 40P01)", "TRANSIENT_CONCURRENCY"),
    ("Lock wait timeout exceeded", "TRANSIENT_CONCURRENCY"),
    ("HTTP 429 Too Many Requests: Rate limit exceeded", "TRANSIENT_RATE_LIMIT"),
    ("FAIL unique_pk [FAIL 42 duplicate keys found]", "DATA_QUALITY"),
    ("column 'ledger_party_id' does not exist in relation x", "STRUCTURAL_SCHEMA_DRIFT"),
    ("bad column\n...\nrelation not found", "STRUCTURAL_SCHEMA_DRIFT"),
    ("Compilation Error in model", "STRUCTURAL_SYNTAX"),
    ("Sensor has timed out", "DEPENDENCY_LAG"),
    ("could not connect: Connection timed out after 60000ms", "TRANSIENT_NETWORK"),
    ("503 Service Unavailable", "TRANSIENT_NETWORK"),
    ("credentials have expired", "UNKNOWN"),
    ("relation not found", "UNKNOWN"),
    ("", "UNKNOWN"),
    (None, "UNKNOWN"),
    # two signatures: the earlier rule decides
    ("lock wait timeout, then out of memory", "TRANSIENT_OOM"),
    ("rate limit hit; connection reset", "TRANSIENT_RATE_LIMIT"),
    # digits inside a larger number count in the default rule set
    ("settled 14294 units", "TRANSIENT_RATE_LIMIT"),
]


def classify(spark, texts, strict=False):
    rows = spark.createDataFrame(
        [(i, t, "failed") for i, t in enumerate(texts)], "i int, log_text string, state string"
    )
    got = triage.classify_failures(rows, strict).collect()
    return {r.i: r.failure_category for r in got}


def test_categories(spark):
    got = classify(spark, [text for text, _ in LOGS])
    assert got == {i: category for i, (_, category) in enumerate(LOGS)}


def test_every_rule_is_covered():
    assert {c for _, c in LOGS} == set(CATEGORIES)
    assert len(SIGNATURES) == 15


def test_strict_wants_a_whole_status_code(spark):
    got = classify(spark, ["settled 14294 units", "HTTP 429 from host", "429"], strict=True)
    assert got == {0: "UNKNOWN", 1: "TRANSIENT_RATE_LIMIT", 2: "TRANSIENT_RATE_LIMIT"}


def test_rule_order_on_every_pair(spark):
    """A text with the phrases of two rules takes the earlier rule."""
    phrase = [" ".join((r.any_of[0], *r.also[:1])) for r in SIGNATURES]
    pairs = [(a, b) for a in range(15) for b in range(15) if a != b]
    got = classify(spark, [f"{phrase[b]} | {phrase[a]}" for a, b in pairs])
    for i, (a, b) in enumerate(pairs):
        assert got[i] == SIGNATURES[min(a, b)].category


def test_successes_are_not_classified(spark):
    rows = spark.createDataFrame([("429", "success")], "log_text string, state string")
    assert triage.classify_failures(rows).count() == 0
    assert triage.classify_failures(rows, failed_only=False).count() == 1


@pytest.mark.parametrize(
    "operator, code, level",
    [
        ("KubernetesPodOperator", "MERGE INTO target USING source", "GUARANTEED_IDEMPOTENT"),
        ("KubernetesPodOperator", "insert overwrite table events", "GUARANTEED_IDEMPOTENT"),
        ("DbtRunOperator", "run", "GUARANTEED_IDEMPOTENT"),
        ("Python", "call DBT", "GUARANTEED_IDEMPOTENT"),
        ("Python", "truncate t; insert into t", "GUARANTEED_IDEMPOTENT"),
        ("CustomSQL", "INSERT INTO ledger VALUES (1, 100)", "POTENTIALLY_UNSAFE"),
        ("CustomSQL", "insert into t select 1 where not exists (select 1)", "CONDITIONAL_IDEMPOTENT"),
        ("CustomSQL", "insert into t values (1) on conflict do nothing", "CONDITIONAL_IDEMPOTENT"),
        ("CustomSQL", "select 1", "CONDITIONAL_IDEMPOTENT"),
        (None, None, "CONDITIONAL_IDEMPOTENT"),
    ],
)
def test_idempotency(spark, operator, code, level):
    rows = spark.createDataFrame([(operator, code)], "operator string, code string")
    assert triage.check_idempotency(rows).first().idempotency_level == level


def decide(spark, log, attempt=1, code="MERGE INTO", memory=None, **limits):
    rows = spark.createDataFrame(
        [(log, "failed", attempt, "K8s", code, memory)],
        "log_text string, state string, attempt int, operator string, code string, requested_memory int",
    )
    return triage.evaluate_policy(triage.classify_failures(rows), PolicyLimits(**limits)).first()


@pytest.mark.parametrize(
    "memory, action, allowed, params",
    [
        (None, "BUMP_POD_MEMORY_AND_CLEAR", True, {"memory_limit": "4096Mi", "memory_request": "2048Mi"}),
        (0, "BUMP_POD_MEMORY_AND_CLEAR", True, {"memory_limit": "4096Mi", "memory_request": "2048Mi"}),
        (4097, "BUMP_POD_MEMORY_AND_CLEAR", True, {"memory_limit": "4097Mi", "memory_request": "2048Mi"}),
        (16384, "BUMP_POD_MEMORY_AND_CLEAR", True, {"memory_limit": "16384Mi", "memory_request": "8192Mi"}),
        (16385, "ESCALATE_TO_HUMAN", False, {}),
    ],
)
def test_memory_policy(spark, memory, action, allowed, params):
    got = decide(spark, "oomkilled", memory=memory)
    assert (got.recommended_action, got.can_auto_remediate, got.action_parameters) == (action, allowed, params)
    assert len(got.violations) == (0 if allowed else 1)
    assert len(got.reasons) == (1 if allowed else 0)


def test_retry_cap_keeps_the_action(spark):
    got = decide(spark, "Exit code 137 OOMKilled", attempt=3)
    assert not got.can_auto_remediate
    assert got.recommended_action == "BUMP_POD_MEMORY_AND_CLEAR"
    assert len(got.violations) == 1
    assert decide(spark, "oomkilled", attempt=2).can_auto_remediate


def test_unsafe_code_blocks(spark):
    got = decide(spark, "deadlockdetected", code="INSERT INTO t VALUES (1)")
    assert not got.can_auto_remediate and got.recommended_action == "CLEAR_TASK_INSTANCE"
    assert got.action_parameters == {"backoff_seconds": "10"}
    open_gate = decide(spark, "deadlockdetected", code="INSERT INTO t", block_unsafe_retry=False)
    assert open_gate.can_auto_remediate


def test_late_upstream_lifts_gates_unless_strict(spark):
    lag = dict(log="sensor has timed out", attempt=3, code="INSERT INTO t")
    loose, strict = decide(spark, **lag), decide(spark, **lag, strict_gates=True)
    assert loose.can_auto_remediate and not strict.can_auto_remediate
    assert len(loose.violations) == len(strict.violations) == 2
    assert loose.recommended_action == "TRIGGER_UPSTREAM_DAG"


def test_strict_automation_implies_no_violation(spark):
    rows = spark.createDataFrame(
        [(log, "failed", n, "K8s", code, mem) for log, _ in LOGS for n in (1, 3)
         for code in ("MERGE INTO", "INSERT INTO t") for mem in (None, 20000)],
        "log_text string, state string, attempt int, operator string, code string, requested_memory int",
    )
    got = triage.evaluate_policy(triage.classify_failures(rows), PolicyLimits(strict_gates=True))
    assert got.where("can_auto_remediate AND size(violations) > 0").count() == 0
    assert got.count() == rows.count()


def test_sql_functions_agree(spark):
    register_functions(spark)
    rows = spark.createDataFrame([(text, category) for text, category in LOGS if text], "t string, c string")
    rows.createOrReplaceTempView("texts")
    assert spark.sql("SELECT * FROM texts WHERE failure_category(t) <> c").count() == 0
    assert spark.sql("SELECT safe_ratio(1, 0) AS r").first().r is None


def test_approvals_are_stable(spark):
    rows = spark.createDataFrame(
        [("column x does not exist", "failed", 1, "K8s", "dbt run", None, "c", "dbt_dag", "t", "r")],
        "log_text string, state string, attempt int, operator string, code string, requested_memory int, "
        "cluster string, dag_id string, task_id string, run_id string",
    )
    routed = triage.route_incidents(triage.evaluate_policy(triage.classify_failures(rows)))
    first, second = (triage.approval_requests(routed).first() for _ in range(2))
    assert first == second
    assert first.channel == "#team-analytics-eng" and first.status == "PENDING"
    assert first.action_type == "MERGE_PR_AND_RESUME_PIPELINE"
    assert routed.select(F.col("route")).first().route == "approval"
