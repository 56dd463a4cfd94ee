"""Incident coordinates in free text, and parts of object addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# How a prompt names each coordinate, quoted form first.
MARKERS: dict[str, tuple[str, str | None]] = {
    "cluster": ("cluster '", "cluster "),
    "dag_id": ("DAG '", "dag_id="),
    "task_id": ("task '", "task_id="),
    "run_id": ("run '", None),
}

# What is assumed when neither prompt nor payload says.
DEFAULTS = {
    "cluster": "gke-prod-us-central1",
    "dag_id": "analytics_daily_etl",
    "task_id": "run_dbt_heavy_aggregation",
    "run_id": "manual__2026-09-29T10:00:00",
    "operator": "KubernetesPodOperator",
}


def or_default(column: Column, default: Column | str) -> Column:
    """The column, or the default where it is null or empty."""
    default = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(column, F.lit("")), default)


def coordinate(prompt: Column, name: str, fallback: Column) -> Column:
    """One coordinate: quoted form, else bare form, else ``fallback``."""
    quoted, bare = MARKERS[name]
    found = F.when(
        F.contains(prompt, F.lit(quoted)), F.regexp_extract(prompt, f"{quoted}([^']*)", 1)
    )
    if bare:
        word = F.regexp_extract(prompt, f"{bare}([^ ]*)", 1)
        found = found.when(
            F.contains(prompt, F.lit(bare)), F.regexp_replace(word, "^[',\"]+|[',\"]+$", "")
        )
    return found.otherwise(fallback)


def uri_bucket(uri: Column) -> Column:
    return F.regexp_extract(F.replace(uri, F.lit("s3://"), F.lit("")), "^([^/]*)", 1)


def uri_key(uri: Column) -> Column:
    return F.regexp_extract(F.replace(uri, F.lit("s3://"), F.lit("")), "^[^/]*/(.*)$", 1)


def key_values(key: Column) -> Column:
    """The ``name=value`` folders of a key as a map."""
    folders = F.filter(F.split(key, "/"), lambda part: F.contains(part, F.lit("=")))
    return F.map_from_entries(
        F.transform(
            folders,
            lambda part: F.struct(
                F.substring_index(part, "=", 1), F.regexp_extract(part, "^[^=]*=(.*)$", 1)
            ),
        )
    )


def last_segment(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def repo_from_url(url: Column) -> Column:
    return F.replace(last_segment(url), F.lit(".git"), F.lit(""))


def default_pod(task_id: Column) -> Column:
    return F.concat(F.lit("airflow-worker-"), task_id, F.lit("-pod"))


def memory_mib(quantity: Column) -> Column:
    """``2048Mi`` or ``50Gi`` as whole MiB, null when unreadable."""
    amount = F.regexp_extract(quantity, r"^(\d+)(Mi|Gi)$", 1).try_cast("long")
    return amount * F.when(F.endswith(quantity, F.lit("Gi")), 1024).otherwise(1)


def duration_seconds(quantity: Column) -> Column:
    """``2h``, ``30m`` or ``10s`` as seconds, null when unreadable."""
    amount = F.regexp_extract(quantity, r"^(\d+)([hms])$", 1).try_cast("long")
    unit = F.right(quantity, F.lit(1))
    return amount * F.when(unit == "h", 3600).when(unit == "m", 60).otherwise(1)
