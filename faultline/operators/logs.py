"""Operators over whole attempt logs. One log is one row, so none of them shuffles
text: lines and figures are taken inside the row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from faultline.functions import text as X


def latest_attempt(logs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per ``keys``, ``order`` ranking from old to new; ``order`` must tell rows of a key apart.

    The winners are found on the narrow columns, as maxima summed up before the
    shuffle. Then only they fetch their texts, by a semi-join, for which Spark can
    broadcast them or filter the text scan by them.
    """
    best = F.max(F.struct(*order)).alias("_best")
    winners = logs.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(best)
    winners = winners.select(*[f"_k{i}" for i in range(len(keys))], *[F.col("_best")[c].alias(f"_o{i}") for i, c in enumerate(order)])
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        + [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(order)],
    )
    return logs.join(winners, same, "left_semi")


TASK_KEY = ["cluster", "dag_id", "task_id"]
LOG_ORDER = ["execution_date", "attempt", "uri"]


def lookup_logs(requests: DataFrame, logs: DataFrame) -> DataFrame:
    """Add ``log_text``, ``uri`` and ``log_found`` to each request.

    The log of the exact ``execution_date`` and ``attempt`` is taken, else the
    newest log of the task. A task without logs has ``log_found = false``.

    Addresses are settled on narrow columns. The few different addresses then pick
    their texts out of the lake by an inner join, with the folder values among its
    keys, and only those texts travel on to the requests.
    """
    exact_key = [*TASK_KEY, "execution_date", "attempt"]
    index = logs.select(*exact_key, "uri")
    newest = index.groupBy(*TASK_KEY).agg(F.max(F.struct(*LOG_ORDER)).alias("_newest"))
    address = F.struct(*LOG_ORDER)
    settled = (
        requests.join(index.select(*exact_key, address.alias("_exact")), exact_key, "left")
        .join(newest, TASK_KEY, "left")
        .withColumn("_at", F.coalesce("_exact", "_newest"))
        .drop("_exact", "_newest")
    )
    wanted = settled.where("_at IS NOT NULL").select(
        *TASK_KEY, F.col("_at.execution_date").alias("execution_date"), F.col("_at.uri").alias("uri")
    ).distinct()
    texts = logs.select(*TASK_KEY, "execution_date", "uri", "log_text").join(
        wanted, [*TASK_KEY, "execution_date", "uri"]
    ).select("uri", "log_text")
    return (
        settled.withColumn("uri", F.col("_at.uri")).drop("_at")
        .join(texts, "uri", "left")
        .withColumn("log_found", F.col("log_text").isNotNull())
    )


def tail_lines(logs: DataFrame, n: int, column: str = "log_text") -> DataFrame:
    """Replace the text by its last ``n`` lines."""
    return logs.withColumn(column, X.tail(F.col(column), n))


def evidence_lines(logs: DataFrame, keep: int = 6, within: int = 40, column: str = "log_text") -> DataFrame:
    """Add ``evidence``: the last non-blank lines, stripped."""
    return logs.withColumn("evidence", X.evidence(F.col(column), keep, within))


def redact(logs: DataFrame, column: str = "log_text") -> DataFrame:
    """Blank out credentials in ``column``."""
    return logs.withColumn(column, X.masked(F.col(column)))


def parse_records(logs: DataFrame, carry: list[str], column: str = "log_text") -> DataFrame:
    """One row per log record: a header line and the lines that continue it.

    Text before the first header forms a record without header fields. Columns:
    ``carry``, ``record_no``, ``n_lines``, ``logged_at``, ``src_file``,
    ``src_line``, ``level``, ``message``.
    """
    text = F.regexp_replace(column, r"\n\z", "")
    records = logs.select(
        *carry, F.posexplode(F.split(text, X.HEADER_AHEAD)).alias("record_no", "_record")
    )

    def part(group: int):
        return F.nullif(F.regexp_extract("_record", X.HEADER, group), F.lit(""))

    return records.select(
        *carry,
        "record_no",
        F.size(F.split("_record", "\n")).alias("n_lines"),
        F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")).alias("logged_at"),
        part(2).alias("src_file"),
        part(3).try_cast("int").alias("src_line"),
        part(4).alias("level"),
        F.regexp_replace("_record", X.HEADER, "").alias("message"),
    )


def parse_lines(logs: DataFrame, carry: list[str], column: str = "log_text") -> DataFrame:
    """One row per line; continuation lines take the fields of their header.

    ``(record_no, line_no)`` orders the lines of a log.
    """
    records = parse_records(logs, carry, column)
    return records.select(
        *[c for c in records.columns if c not in ("message", "n_lines")],
        F.posexplode(F.split("message", "\n")).alias("line_no", "line"),
    ).withColumn("is_continuation", (F.col("line_no") > 0) | F.col("level").isNull())


def extract_signals(logs: DataFrame, carry: list[str], column: str = "log_text") -> DataFrame:
    """One row per figure stated in a log: ``signal``, ``occurrence``, ``value``."""

    def named(signal: str):
        return lambda value, i: F.struct(
            F.lit(signal).alias("signal"), i.alias("occurrence"), value.alias("value")
        )

    found = [F.transform(X.numbers(F.col(column), name), named(name)) for name in X.SIGNALS]
    return logs.select(*carry, F.explode(F.flatten(F.array(*found))).alias("_s")).select(
        *carry, "_s.*"
    )


def run_peaks(logs: DataFrame, carry: list[str], column: str = "log_text") -> DataFrame:
    """Peak memory, utilisation, progress and duration stated by each log."""
    text = F.col(column)
    stamps = F.regexp_extract_all(
        text, F.lit(r"\[(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3})\+0000\] \{"), F.lit(1)
    )
    times = F.transform(
        stamps,
        lambda s: F.unix_millis(F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS"))),
    )
    return logs.select(
        *carry,
        F.array_max(
            F.concat(X.numbers(text, "rss_mib"), X.numbers(text, "peak_rss_mib"))
        ).alias("peak_rss_mib"),
        F.array_max(X.numbers(text, "utilization_pct")).alias("utilization_pct"),
        F.array_max(X.numbers(text, "model_index")).alias("models_done"),
        F.array_max(X.numbers(text, "model_total")).alias("models_total"),
        ((F.array_max(times) - F.array_min(times)) / 1000.0).alias("duration_seconds"),
    )
