"""Alert payloads, task records and incident queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from faultline.functions import coordinates as C

# What an alert carries when the scheduler context lacks a field.
ALERT_DEFAULTS = {
    "event_type": "AIRFLOW_TASK_FAILED",
    "dag_id": "unknown_dag",
    "task_id": "unknown_task",
    "run_id": "unknown_run",
    "operator": "UnknownOperator",
    "exception_type": "AirflowException",
    "exception_message": "Task failed with unhandled exception",
}

# What a task record carries when a field is missing.
TASK_DEFAULTS = {"state": "failed", "try_number": 1, "max_tries": 2, "operator": "KubernetesPodOperator"}


def extract_coordinates(alerts: DataFrame) -> DataFrame:
    """Replace cluster, dag, task, run and operator by what the prompt says, else
    by the payload, else by the default."""
    prompt = F.coalesce("prompt", F.lit(""))
    found = {
        name: C.coordinate(prompt, name, C.or_default(F.col(name), C.DEFAULTS[name]))
        for name in C.MARKERS
    }
    found["operator"] = C.or_default(F.col("operator"), C.DEFAULTS["operator"])
    return alerts.withColumns(found)


def build_alert(contexts: DataFrame) -> DataFrame:
    """Alert payload from scheduler contexts.

    Reads ``cluster``, ``pod_name``, ``dag`` and context fields (``run_id``,
    ``execution_date``), the task instance struct ``ti`` (may be null) and the
    exception fields. The prompt states the coordinates in quoted form.
    """
    d = ALERT_DEFAULTS
    has_ti = F.col("ti").isNotNull()
    dag_id = F.coalesce(F.col("dag"), F.col("ti.dag_id"), F.lit(d["dag_id"]))
    task_id = F.coalesce(F.col("ti.task_id"), F.lit(d["task_id"]))
    run_id = C.or_default(F.col("run_id"), F.coalesce(F.col("ti.run_id"), F.lit(d["run_id"])))
    operator = F.coalesce(F.col("ti.operator"), F.lit(d["operator"]))
    when = F.when(
        has_ti, C.or_default(F.col("execution_date"), F.coalesce("ti.execution_date", F.lit("")))
    ).otherwise(F.lit(""))
    exception_type = F.coalesce("exception_type", F.lit(d["exception_type"]))
    message = F.coalesce("exception_message", F.lit(d["exception_message"]))
    return contexts.select(
        F.lit(d["event_type"]).alias("event_type"),
        "cluster",
        dag_id.alias("dag_id"),
        task_id.alias("task_id"),
        run_id.alias("run_id"),
        F.coalesce("ti.try_number", F.lit(1)).alias("try_number"),
        operator.alias("operator"),
        "pod_name",
        when.alias("execution_date"),
        exception_type.alias("exception_type"),
        message.alias("exception_message"),
        F.format_string(
            "Failure on cluster '%s' in DAG '%s' task '%s' run '%s'. Operator %s raised %s: %s",
            "cluster", dag_id, task_id, run_id, operator, exception_type, message,
        ).alias("prompt"),
    )


def task_instances(records: DataFrame) -> DataFrame:
    """Task records with defaults for missing fields."""
    d = TASK_DEFAULTS
    return records.withColumns(
        {
            "state": F.coalesce("state", F.lit(d["state"])),
            "try_number": F.coalesce("try_number", F.lit(d["try_number"])),
            "max_tries": F.coalesce("max_tries", F.lit(d["max_tries"])),
            "operator": F.coalesce("operator", F.lit(d["operator"])),
            "pod_name": F.coalesce(F.col("pod_name"), C.default_pod(F.col("task_id"))),
            "duration_seconds": F.coalesce("duration_seconds", F.lit(0.0)),
        }
    )


def retry_budget(attempts: DataFrame, max_auto_retries: int = 2, max_tries: int = 2) -> DataFrame:
    """Attempts used per task run and whether automatic retries are spent."""
    used = F.max("attempt")
    return attempts.groupBy("cluster", "dag_id", "task_id", "execution_date").agg(
        F.count("*").alias("n_attempts"),
        used.alias("last_attempt"),
        F.greatest(F.lit(max_tries) - used, F.lit(0)).alias("tries_left"),
        (used > max_auto_retries).alias("auto_blocked"),
    )


def match_known_incident(
    incidents: DataFrame, labels: DataFrame, fallback: str = "oom_exit_code_137"
) -> DataFrame:
    """Attach the known scenario of the same DAG, else of the same cluster, else
    the fallback. ``labels`` has ``ord``, ``dag_id``, ``cluster``, ``scenario_id``."""
    by_dag = labels.groupBy("dag_id").agg(F.min_by("scenario_id", "ord").alias("_by_dag"))
    by_cluster = labels.groupBy("cluster").agg(F.min_by("scenario_id", "ord").alias("_by_cluster"))
    return (
        incidents.join(by_dag, "dag_id", "left")
        .join(by_cluster, "cluster", "left")
        .withColumn("scenario_id", F.coalesce("_by_dag", "_by_cluster", F.lit(fallback)))
        .withColumn(
            "matched_by",
            F.when(F.col("_by_dag").isNotNull(), "dag")
            .when(F.col("_by_cluster").isNotNull(), "cluster")
            .otherwise("default"),
        )
        .drop("_by_dag", "_by_cluster")
    )


def triage_queue(incidents: DataFrame, sla: DataFrame, k: int) -> DataFrame:
    """The ``k`` most urgent open incidents: service tier first, then age."""
    tiered = incidents.join(sla, "dag_id", "left").withColumn("tier", F.coalesce("tier", F.lit(9)))
    return tiered.orderBy("tier", "ts", "run_id").limit(k)


def triage_queue_per_team(incidents: DataFrame, sla: DataFrame, k: int) -> DataFrame:
    """The ``k`` most urgent incidents of each team, ranked.

    Spark applies the rank limit before the shuffle, so a busy team sends at most
    ``k`` rows per task.
    """
    tiered = incidents.join(sla, "dag_id", "left").withColumns(
        {"tier": F.coalesce("tier", F.lit(9)), "team": F.coalesce("team", F.lit("@oncall"))}
    )
    rank = F.row_number().over(Window.partitionBy("team").orderBy("tier", "ts", "run_id"))
    return tiered.withColumn("rank", rank).where(F.col("rank") <= k)
