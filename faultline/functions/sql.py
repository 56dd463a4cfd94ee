"""The rules as temporary SQL functions, for users who write SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from faultline.functions.policy import idempotency_sql
from faultline.functions.signatures import category_sql


def register_functions(spark: SparkSession) -> None:
    """Define ``failure_category(text)``, ``idempotency_level(operator, code)`` and
    ``safe_ratio(a, b)``. They expand to plain expressions, not to user code."""
    bodies = {
        "failure_category(log_text STRING) RETURNS STRING": category_sql("log_text"),
        "idempotency_level(operator STRING, code STRING) RETURNS STRING": idempotency_sql(
            "operator", "code"
        ),
        "safe_ratio(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "a / nullif(b, 0)",
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
