"""Classify failed attempts, apply policy, route the outcome.

All of it is row-wise: one projection over the attempts, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions import policy as P
from faultline.functions.signatures import failure_category

SCHEMA_DRIFT = "STRUCTURAL_SCHEMA_DRIFT"
MERGE_AND_RESUME = "MERGE_PR_AND_RESUME_PIPELINE"


def classify_failures(
    attempts: DataFrame, strict: bool = False, failed_only: bool = True
) -> DataFrame:
    """Add ``failure_category``; by default keep failed attempts only.

    Successful runs carry no signature of their own, so a state filter comes
    first. The lower-cased text is projected once and read by every rule. The
    category leaves through a one-element ``explode``: a plain projection would be
    copied into every later filter on the category and run the rules twice.
    """
    rows = attempts.where("state = 'failed'") if failed_only else attempts
    category = failure_category(F.col("_lowered"), strict)
    return rows.withColumn("_lowered", F.lower("log_text")).select(
        *attempts.columns, F.explode(F.array(category)).alias("failure_category")
    )


def check_idempotency(tasks: DataFrame) -> DataFrame:
    """Add ``idempotency_level`` from ``operator`` and ``code``."""
    return tasks.withColumn(
        "idempotency_level", P.idempotency_level(F.col("operator"), F.col("code"))
    )


def infer_code(tasks: DataFrame) -> DataFrame:
    """Fill a missing statement: dbt jobs run dbt, all others merge."""
    assumed = F.when(F.contains("dag_id", F.lit("dbt")), "dbt run").otherwise("MERGE INTO")
    return tasks.withColumn("code", F.coalesce(F.nullif("code", F.lit("")), assumed))


def evaluate_policy(
    classified: DataFrame, limits: P.PolicyLimits = P.PolicyLimits()
) -> DataFrame:
    """Add the policy decision to classified attempts.

    Reads ``attempt``, ``operator``, ``code``, ``requested_memory`` and
    ``failure_category``; adds ``idempotency_level``, ``can_auto_remediate``,
    ``recommended_action``, ``reasons``, ``violations``, ``action_parameters``.
    A failed gate blocks automation but leaves the recommended action as it is.
    """
    rows = check_idempotency(classified).withColumn(
        "_target", P.target_memory(F.col("requested_memory"), limits)
    )
    category = F.col("failure_category")
    target = F.col("_target")
    tries = F.coalesce("attempt", F.lit(1))

    too_many = tries > limits.max_auto_retries
    unsafe = F.lit(limits.block_unsafe_retry) & (F.col("idempotency_level") == P.UNSAFE)
    too_large = (category == "TRANSIENT_OOM") & (target > limits.max_memory_mb)
    gates_open = ~too_many & ~unsafe

    forbidden = [name for name, (_, blocked) in P.ACTIONS.items() if blocked]
    known = list(P.ACTIONS)
    can_auto = (
        F.when(~category.isin(known) | category.isin(forbidden) | too_large, False)
        .when(category == "DEPENDENCY_LAG", gates_open if limits.strict_gates else F.lit(True))
        .otherwise(gates_open)
    )
    action = F.when(too_large, P.ESCALATE).otherwise(
        P.by_category(
            category,
            {name: F.lit(act) for name, (act, _) in P.ACTIONS.items()},
            F.lit(P.ESCALATE),
        )
    )
    violations = F.array_compact(
        F.array(
            F.when(
                too_many,
                F.format_string(
                    f"attempt %d is past the limit of {limits.max_auto_retries} automatic retries",
                    tries,
                ),
            ),
            F.when(unsafe, "statement appends rows and would repeat them on a second run"),
            F.when(
                too_large,
                F.format_string(
                    f"%d MB requested, above the ceiling of {limits.max_memory_mb} MB", target
                ),
            ),
        )
    )
    reason = F.when(
        category == "TRANSIENT_OOM",
        F.when(
            ~too_large,
            F.format_string("container ran out of memory; raise the limit to %dMi", target),
        ),
    ).otherwise(
        P.by_category(
            category,
            {name: F.lit(text) for name, text in P.REASONS.items()},
            F.lit("cause unclear or not repairable by a re-run; hand over to a person"),
        )
    )
    return rows.select(
        *classified.columns,
        "idempotency_level",
        can_auto.alias("can_auto_remediate"),
        action.alias("recommended_action"),
        F.array_compact(F.array(reason)).alias("reasons"),
        violations.alias("violations"),
        P.action_parameters(category, target, limits).alias("action_parameters"),
    )


def route_incidents(
    decisions: DataFrame, human_categories: tuple[str, ...] = (SCHEMA_DRIFT,)
) -> DataFrame:
    """Choose approval, execution or report for each decision.

    ``human_categories`` lists the categories whose change a person must approve;
    add ``STRUCTURAL_DIVISION_BY_ZERO`` to review guard patches too.
    """
    human = F.col("failure_category").isin(*human_categories)
    return (
        decisions.withColumn("requires_human", human)
        .withColumn(
            "remediation_action",
            F.when(human, MERGE_AND_RESUME).otherwise(F.col("recommended_action")),
        )
        .withColumn(
            "approval_status", F.when(human, "PENDING").otherwise("AUTO_APPROVED")
        )
        .withColumn(
            "route",
            F.when(human, "approval")
            .when(F.col("can_auto_remediate"), "execute")
            .otherwise("report"),
        )
    )


def incident_key() -> Column:
    """Stable identity of one attempt."""
    return F.concat_ws("/", "cluster", "dag_id", "task_id", "run_id", F.col("attempt").cast("string"))


def approval_requests(
    routed: DataFrame,
    analytics_channel: str = "#team-analytics-eng",
    platform_channel: str = "#data-platform-alerts",
    risk_level: str = "MEDIUM",
) -> DataFrame:
    """One pending request per incident that a person must decide.

    The id is the whole digest of the incident, so a repeated job emits the same
    request and no two incidents share one. ``code_diff`` and ``pr_url`` come along
    where ``routed`` has them, else they are null.
    """
    extra = [
        F.col(c) if c in routed.columns else F.lit(None).cast("string").alias(c) for c in ("code_diff", "pr_url")
    ]
    change = F.when(
        F.contains("remediation_action", F.lit("PR")),
        F.lit("merge the drafted change and clear the task"),
    ).otherwise(F.lit("raise the worker memory limit and clear the task"))
    return routed.where("requires_human").select(
        F.concat(F.lit("apr-"), F.sha2(incident_key(), 256)).alias("approval_id"),
        "cluster",
        "dag_id",
        "task_id",
        "run_id",
        F.col("remediation_action").alias("action_type"),
        change.alias("proposed_change"),
        F.lit(risk_level).alias("risk_level"),
        F.when(F.contains("dag_id", F.lit("dbt")), analytics_channel)
        .otherwise(platform_channel)
        .alias("channel"),
        F.col("failure_category").alias("root_cause"),
        F.col("approval_status").alias("status"),
        *extra,
    )


def remediation_ledger(routed: DataFrame) -> DataFrame:
    """One row per action taken, as an append-only log. Nothing is called.

    Triggering an upstream run is booked on the upstream cluster and DAG; an
    action outside the executable set is booked as failed.
    """
    action = F.col("remediation_action")
    params = F.col("action_parameters")
    bump = action == "BUMP_POD_MEMORY_AND_CLEAR"
    clear = action == "CLEAR_TASK_INSTANCE"
    upstream = action == "TRIGGER_UPSTREAM_DAG"
    change = action.isin("CREATE_GITHUB_PR", MERGE_AND_RESUME)
    executable = bump | clear | upstream | change
    return routed.where("route <> 'report'").select(
        "run_id",
        F.when(executable, "SUCCESS").otherwise("FAILED").alias("status"),
        action.alias("action_taken"),
        F.when(upstream, params["upstream_cluster"]).otherwise(F.col("cluster")).alias("cluster"),
        F.when(upstream, params["upstream_dag_id"]).otherwise(F.col("dag_id")).alias("dag_id"),
        F.when(~upstream, F.col("task_id")).alias("task_id"),
        F.when(clear, params["backoff_seconds"].cast("int")).alias("backoff_seconds"),
        F.when(bump, F.format_string("memory limit set to %s, task cleared", params["memory_limit"]))
        .when(clear, F.format_string("task cleared after %s s", params["backoff_seconds"]))
        .when(
            upstream,
            F.format_string(
                "run of %s started on %s", params["upstream_dag_id"], params["upstream_cluster"]
            ),
        )
        .when(change, F.lit("code change handed over"))
        .otherwise(F.format_string("action %s is not executable", action))
        .alias("details"),
        (bump | clear | upstream | (action == MERGE_AND_RESUME)).alias("retry_scheduled"),
        params.alias("parameters"),
    )


def incident_report(routed: DataFrame) -> DataFrame:
    """A short outcome line per incident."""
    resolved = ~F.col("requires_human") & F.col("can_auto_remediate")
    outcome = F.when(resolved, "RESOLVED_AUTOMATICALLY").otherwise("NEEDS_HUMAN")
    return routed.select(
        "cluster",
        "dag_id",
        "task_id",
        "run_id",
        "failure_category",
        "remediation_action",
        "approval_status",
        outcome.alias("outcome"),
        F.format_string(
            "%s.%s on %s: %s, %s gate, action %s",
            "dag_id",
            "task_id",
            "cluster",
            "failure_category",
            "idempotency_level",
            "remediation_action",
        ).alias("summary"),
    )


def incident_rollup(routed: DataFrame) -> DataFrame:
    """Counts by cluster, DAG and category with subtotals and automation rate.

    Rows are first counted at the finest level; only those counts are expanded
    for the subtotals.
    """
    finest = routed.groupBy("cluster", "dag_id", "failure_category").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("route") == "execute").alias("n_auto"),
    )
    return (
        finest.rollup("cluster", "dag_id", "failure_category")
        .agg(
            F.sum("n").alias("incidents"),
            F.sum("n_auto").alias("auto_resolved"),
            F.grouping_id().cast("int").alias("level"),
        )
        .withColumn("auto_rate", F.round(F.col("auto_resolved") / F.col("incidents"), 6))
    )
