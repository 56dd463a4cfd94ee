"""Failure classification by log signature.

``SIGNATURES`` is the whole rule book: the first row whose phrases occur in the
lower-cased attempt text decides. Rules are plain data so that the batch job, the
stream and the SQL function share one definition.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, functions as F


class Signature(NamedTuple):
    category: str
    any_of: tuple[str, ...]
    also: tuple[str, ...] = ()  # when given, one of these must occur as well


# Categories and phrases, in order of precedence.
SIGNATURES: tuple[Signature, ...] = (
    Signature("TRANSIENT_OOM", ("exit code 137", "oomkilled", "out of memory")),
    Signature(
        "TRANSIENT_SPOT_PREEMPTION",
        ("terminatedbypreemption", "preemption notice", "exit code 143"),
    ),
    Signature(
        "TRANSIENT_DISK_FULL",
        ("no space left on device", "ephemeral-storage", "errno 28"),
    ),
    Signature("TRANSIENT_STATEMENT_TIMEOUT", ("statement timeout",)),
    Signature(
        "TRANSIENT_CONNECTION_POOL",
        ("connection slots are reserved", "connection pool exhausted"),
    ),
    Signature("TRANSIENT_CLOCK_SKEW", ("requesttimetooskewed", "clock drifted")),
    Signature("STRUCTURAL_DIVISION_BY_ZERO", ("division by zero",)),
    Signature(
        "SILENT_DATA_ANOMALY",
        ("zero rows in daily ingest", "zero_rows_delivered"),
    ),
    Signature(
        "TRANSIENT_CONCURRENCY",
        ("deadlockdetected", "error 40p01", "lock wait timeout"),
    ),
    Signature("TRANSIENT_RATE_LIMIT", ("429", "rate limit", "too many requests")),
    Signature(
        "DATA_QUALITY",
        ("duplicate keys found", "data quality", "fail unique_"),
    ),
    Signature(
        "STRUCTURAL_SCHEMA_DRIFT",
        ("column",),
        also=("does not exist", "not found"),
    ),
    Signature("STRUCTURAL_SYNTAX", ("syntax error", "compilation error")),
    Signature("DEPENDENCY_LAG", ("sensor has timed out", "partition not ready")),
    Signature(
        "TRANSIENT_NETWORK",
        ("connection reset", "connection timed out", "503 service unavailable"),
    ),
)
UNKNOWN = "UNKNOWN"
CATEGORIES: tuple[str, ...] = tuple(s.category for s in SIGNATURES) + (UNKNOWN,)

# Strict mode wants the status code as a number of its own, not as digits inside
# an amount or an id.
STRICT_PATTERNS = {"429": r"\b429\b"}


def _occurs(text: Column, phrase: str, strict: bool) -> Column:
    if strict and phrase in STRICT_PATTERNS:
        return text.rlike(STRICT_PATTERNS[phrase])
    return F.contains(text, F.lit(phrase))


def _one_of(text: Column, phrases: tuple[str, ...], strict: bool) -> Column:
    return reduce(lambda a, b: a | b, (_occurs(text, p, strict) for p in phrases))


def matches(lowered: Column, rule: Signature, strict: bool = False) -> Column:
    """Whether one rule holds on text that is already lower-cased."""
    hit = _one_of(lowered, rule.any_of, strict)
    return hit & _one_of(lowered, rule.also, strict) if rule.also else hit


def failure_category(lowered: Column, strict: bool = False) -> Column:
    """Category of one attempt from its whole, already lower-cased text.

    ``CASE`` stops at the first branch that holds, so precedence costs nothing
    extra. Null text is unknown.
    """
    branches = [(matches(lowered, rule, strict), rule.category) for rule in SIGNATURES]
    first, *rest = branches
    case = F.when(first[0], first[1])
    for condition, category in rest:
        case = case.when(condition, category)
    return case.otherwise(UNKNOWN)


def category_sql(text: str) -> str:
    """The same rule book as a SQL ``CASE`` over the expression ``text``."""

    def any_sql(phrases: tuple[str, ...]) -> str:
        return "(" + " OR ".join(f"contains(lower({text}), '{p}')" for p in phrases) + ")"

    whens = []
    for rule in SIGNATURES:
        condition = any_sql(rule.any_of)
        if rule.also:
            condition += " AND " + any_sql(rule.also)
        whens.append(f"WHEN {condition} THEN '{rule.category}'")
    return "CASE " + " ".join(whens) + f" ELSE '{UNKNOWN}' END"
