"""From alert to routed decision with an owner, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.functions.policy import PolicyLimits
from faultline.operators import alerts as alert_ops
from faultline.operators import logs as log_ops
from faultline.operators import triage


def alert_decisions(
    alerts: DataFrame,
    logs: DataFrame,
    tasks: DataFrame | None = None,
    limits: PolicyLimits = PolicyLimits(),
    strict: bool = False,
) -> DataFrame:
    """Decide on each alert from the log of the task it names.

    ``alerts`` has payload fields, ``prompt``, ``try_number`` and
    ``execution_date``; ``tasks`` may add ``code`` and ``requested_memory`` per
    (cluster, dag_id, task_id). Without code the statement is inferred.
    """
    named = alert_ops.extract_coordinates(alerts).withColumnRenamed("try_number", "attempt")
    found = log_ops.lookup_logs(named, logs)
    if tasks is not None:
        found = found.join(
            tasks.select(*log_ops.TASK_KEY, "code", "requested_memory"), log_ops.TASK_KEY, "left"
        )
    else:
        found = found.withColumns(
            {"code": F.lit(None).cast("string"), "requested_memory": F.lit(None).cast("int")}
        )
    classified = triage.classify_failures(
        triage.infer_code(found).withColumn("log_text", F.coalesce("log_text", F.lit(""))),
        strict,
        failed_only=False,
    )
    return triage.route_incidents(triage.evaluate_policy(classified, limits))
