"""Re-run safety and remediation policy as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

# Idempotency levels. The last one is part of the vocabulary but no
# rule yields it.
GUARANTEED = "GUARANTEED_IDEMPOTENT"
CONDITIONAL = "CONDITIONAL_IDEMPOTENT"
UNSAFE = "POTENTIALLY_UNSAFE"
NEVER = "NON_IDEMPOTENT"
IDEMPOTENCY_LEVELS = (GUARANTEED, CONDITIONAL, UNSAFE, NEVER)

# Statements that overwrite their target, and clauses that make an
# append repeatable.
REPLACING_STATEMENTS = ("INSERT OVERWRITE", "MERGE INTO", "TRUNCATE")
APPEND_STATEMENT = "INSERT INTO"
APPEND_GUARDS = ("ON CONFLICT", "WHERE NOT EXISTS")


@dataclass(frozen=True)
class PolicyLimits:
    """Limits of automatic action. Values are the defaults in force."""

    max_memory_mb: int = 16384
    default_memory_mb: int = 4096
    max_auto_retries: int = 2
    lock_backoff_seconds: int = 10
    rate_backoff_seconds: int = 30
    block_unsafe_retry: bool = True
    upstream_cluster: str = "gke-analytics-europe-west1"
    upstream_dag_id: str = "eu_raw_ingestion_hourly"
    # When set, a missing upstream partition no longer lifts a failed gate.
    strict_gates: bool = False


# Action per category, and whether policy forbids doing it unattended.
ACTIONS: dict[str, tuple[str, bool]] = {
    "TRANSIENT_OOM": ("BUMP_POD_MEMORY_AND_CLEAR", False),
    "TRANSIENT_CONCURRENCY": ("CLEAR_TASK_INSTANCE", False),
    "TRANSIENT_RATE_LIMIT": ("CLEAR_TASK_INSTANCE", False),
    "DATA_QUALITY": ("ALERT_DATA_STEWARDS", True),
    "STRUCTURAL_SCHEMA_DRIFT": ("CREATE_GITHUB_PR", True),
    "TRANSIENT_SPOT_PREEMPTION": ("RESCHEDULE_ON_DEMAND_POOL", False),
    "TRANSIENT_DISK_FULL": ("BUMP_EPHEMERAL_STORAGE_AND_CLEAR", False),
    "TRANSIENT_STATEMENT_TIMEOUT": ("BUMP_STATEMENT_TIMEOUT_AND_CLEAR", False),
    "TRANSIENT_CONNECTION_POOL": ("THROTTLE_CONCURRENCY_AND_CLEAR", False),
    "TRANSIENT_CLOCK_SKEW": ("RESCHEDULE_SYNCED_NODE_AND_CLEAR", False),
    "STRUCTURAL_DIVISION_BY_ZERO": ("CREATE_GITHUB_PR", True),
    "SILENT_DATA_ANOMALY": ("PAUSE_DOWNSTREAM_DAG_AND_ALERT", True),
    "DEPENDENCY_LAG": ("TRIGGER_UPSTREAM_DAG", False),
}
ESCALATE = "ESCALATE_TO_HUMAN"

# Constant parameters of the actions that take any.
PARAMETERS: dict[str, dict[str, str]] = {
    "TRANSIENT_SPOT_PREEMPTION": {"node_pool": "on-demand-pool"},
    "TRANSIENT_DISK_FULL": {"ephemeral_storage_limit": "50Gi"},
    "TRANSIENT_STATEMENT_TIMEOUT": {"statement_timeout": "2h"},
    "TRANSIENT_CONNECTION_POOL": {"max_active_tasks": "8"},
    "TRANSIENT_CLOCK_SKEW": {"ntp_sync": "true"},
}

# One sentence per category for the decision log.
REASONS: dict[str, str] = {
    "TRANSIENT_CONCURRENCY": "lock conflict between writers; safe to run again after a pause",
    "TRANSIENT_RATE_LIMIT": "remote service asked callers to slow down; run again after a pause",
    "DATA_QUALITY": "a declared data test failed; a second run would fail the same way",
    "STRUCTURAL_SCHEMA_DRIFT": "a referenced column is gone; the code needs a change",
    "TRANSIENT_SPOT_PREEMPTION": "the node was reclaimed; move the task to stable capacity",
    "TRANSIENT_DISK_FULL": "scratch space ran out; raise the storage limit",
    "TRANSIENT_STATEMENT_TIMEOUT": "the statement ran into its time limit; raise the limit",
    "TRANSIENT_CONNECTION_POOL": "database connections ran out; lower task concurrency",
    "TRANSIENT_CLOCK_SKEW": "the node clock is off; move the task to a synchronised node",
    "STRUCTURAL_DIVISION_BY_ZERO": "a divisor was zero; the code needs a guard",
    "SILENT_DATA_ANOMALY": "the delivery was empty; hold back downstream consumers",
    "DEPENDENCY_LAG": "the upstream partition is late; run the upstream job",
}


def _contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in phrases))


def idempotency_level(operator: Column, code: Column) -> Column:
    """Whether running the task again is safe, from operator name and statement."""
    operator = F.lower(F.coalesce(operator, F.lit("")))
    code = F.coalesce(code, F.lit(""))
    statement = F.upper(code)
    is_dbt = F.contains(operator, F.lit("dbt")) | F.contains(F.lower(code), F.lit("dbt"))
    appends = F.contains(statement, F.lit(APPEND_STATEMENT))
    return (
        F.when(is_dbt | _contains_any(statement, REPLACING_STATEMENTS), GUARANTEED)
        .when(appends & ~_contains_any(statement, APPEND_GUARDS), UNSAFE)
        .otherwise(CONDITIONAL)
    )


def idempotency_sql(operator: str, code: str) -> str:
    """``idempotency_level`` as a SQL expression."""

    def any_sql(phrases: tuple[str, ...]) -> str:
        return " OR ".join(f"contains(upper({code}), '{p}')" for p in phrases)

    return (
        f"CASE WHEN contains(lower({operator}), 'dbt') OR contains(lower({code}), 'dbt') "
        f"OR {any_sql(REPLACING_STATEMENTS)} THEN '{GUARANTEED}' "
        f"WHEN contains(upper({code}), '{APPEND_STATEMENT}') "
        f"AND NOT ({any_sql(APPEND_GUARDS)}) THEN '{UNSAFE}' ELSE '{CONDITIONAL}' END"
    )


def by_category(category: Column, values: dict[str, Column], default: Column) -> Column:
    """A lookup on the category. The table is one constant, so generated code stays small."""
    table = F.create_map(*[x for name, value in values.items() for x in (F.lit(name), value)])
    return F.coalesce(table[category], default)


def target_memory(requested: Column, limits: PolicyLimits) -> Column:
    """Memory to ask for; zero counts as not given."""
    return F.coalesce(F.nullif(requested, F.lit(0)), F.lit(limits.default_memory_mb))


def action_parameters(category: Column, target: Column, limits: PolicyLimits) -> Column:
    """Parameters of the recommended action as ``map<string,string>``."""
    empty = F.create_map().cast("map<string,string>")

    def constant(pairs: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])

    def mebibytes(amount: Column) -> Column:
        return F.concat(amount.cast("string"), F.lit("Mi"))

    constants = {name: constant(pairs) for name, pairs in PARAMETERS.items()}
    constants["TRANSIENT_CONCURRENCY"] = constant(
        {"backoff_seconds": str(limits.lock_backoff_seconds)}
    )
    constants["TRANSIENT_RATE_LIMIT"] = constant(
        {"backoff_seconds": str(limits.rate_backoff_seconds)}
    )
    constants["DEPENDENCY_LAG"] = constant(
        {
            "upstream_cluster": limits.upstream_cluster,
            "upstream_dag_id": limits.upstream_dag_id,
        }
    )
    memory = F.create_map(
        F.lit("memory_limit"),
        mebibytes(target),
        F.lit("memory_request"),
        mebibytes(F.floor(target / 2)),
    )
    granted = (category == "TRANSIENT_OOM") & (target <= limits.max_memory_mb)
    return F.when(granted, memory).otherwise(by_category(category, constants, empty))
