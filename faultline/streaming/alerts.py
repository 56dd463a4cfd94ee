"""Structured Streaming forms of triage: the same column functions on unbounded
input, plus the operators that need state. All run in append mode.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from faultline.functions.policy import PolicyLimits
from faultline.operators import triage

ALERT_KEY = ["cluster", "dag_id", "task_id", "run_id", "try_number"]
RUN_KEY = ["cluster", "dag_id", "task_id", "run_id"]


def decide(alerts: DataFrame, limits: PolicyLimits = PolicyLimits()) -> DataFrame:
    """Classify, gate and route each alert as it arrives; stateless."""
    return triage.route_incidents(triage.evaluate_policy(triage.classify_failures(alerts), limits))


def deduplicate(
    alerts: DataFrame, time: str = "received_at", within: str = "1 hour", keys: list[str] = ALERT_KEY
) -> DataFrame:
    """Drop repeats of an alert that arrive within the delay. State expires with
    the watermark."""
    return alerts.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


class RetryBudget(StatefulProcessor):
    """Counts the retries granted to a task run and refuses those past the cap.

    State is a number and a time, whatever the number of alerts. A run is forgotten
    when event time has moved ``ttl_ms`` past its last alert.
    """

    def __init__(self, cap: int, ttl_ms: int):
        self.cap = cap
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("budget", "used int, expires bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        used, expires = self.state.get() if self.state.exists() else (0, None)
        # Only the order within a batch is open: ids and times of its tries, no frames.
        tries = sorted((r["received_at"], r["alert_id"]) for r in rows)
        for n, (_, alert_id) in enumerate(tries, used + 1):
            yield Row(alert_id=alert_id, retry=n, allowed=n <= self.cap)
        last_ms = int(tries[-1][0].timestamp() * 1000)
        if expires is not None:
            self.handle.deleteTimer(expires)
        expires = max(expires or 0, last_ms + self.ttl_ms)
        self.handle.registerTimer(expires)
        self.state.update((used + len(tries), expires))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def retry_budget(
    alerts: DataFrame,
    keys: list[str] = RUN_KEY,
    cap: int = 2,
    ttl_hours: int = 24,
    delay: str = "1 hour",
) -> DataFrame:
    """Number the retries of each run and allow the first ``cap``.

    Repeats of an alert (same id) that arrive within ``delay`` count once. Needs the RocksDB state store.
    """
    return (
        alerts.select(*keys, "alert_id", "received_at")
        .withWatermark("received_at", delay)
        .dropDuplicatesWithinWatermark(["alert_id"])
        .groupBy(*keys)
        .transformWithState(
            statefulProcessor=RetryBudget(cap, ttl_hours * 3_600_000),
            outputStructType="alert_id string, retry int, allowed boolean",
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def saturation_alarms(
    usage: DataFrame,
    threshold: float,
    window: str = "5 minutes",
    slide: str = "1 minute",
    delay: str = "10 minutes",
) -> DataFrame:
    """Windows in which a pod's usage passed ``threshold``.

    A window is reported once the watermark has passed it, so those still open at the
    end of the input are absent.
    """
    return (
        usage.withWatermark("ts", delay)
        .groupBy(F.window("ts", window, slide), "cluster", "pod_name")
        .agg(F.max("value").alias("peak"), F.count("*").alias("samples"))
        .where(F.col("peak") > threshold)
        .select(
            "cluster",
            "pod_name",
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "peak",
            "samples",
        )
    )


def incident_sessions(
    alerts: DataFrame, time: str = "received_at", gap: str = "30 minutes", delay: str = "10 minutes"
) -> DataFrame:
    """Alerts of a task that follow each other closely form one incident.

    Sessions still open at the end of the input are absent.
    """
    return (
        alerts.withWatermark(time, delay)
        .groupBy(F.session_window(time, gap).alias("_w"), "cluster", "dag_id", "task_id")
        .agg(F.count("*").alias("n_alerts"), F.max("try_number").alias("last_try"))
        .select(
            "cluster",
            "dag_id",
            "task_id",
            F.col("_w.start").alias("first_at"),
            F.col("_w.end").alias("ends_at"),
            "n_alerts",
            "last_try",
        )
    )


def correlate(
    alerts: DataFrame,
    events: DataFrame,
    reach_minutes: int = 10,
    step_minutes: int = 1,
    delay: str = "10 minutes",
) -> DataFrame:
    """Attach to each alert a summary of its cluster's events around it.

    The window reaches ``reach_minutes`` to both sides of the step of the clock in which the alert
    lies, so no border cuts off an event next to it. Events are summed up per cluster and step of the
    clock first, and these sums per sliding window, so state and work of the windows do not grow with the
    events; an alert matches one row, not every event around it. An alert without events comes out with zeros once the watermark
    has passed its window. Windows still open at the end of the input are not reported.
    """
    width = f"{2 * reach_minutes + step_minutes} minutes"
    step = f"{step_minutes} minutes"
    steps = (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", step).alias("step"), "cluster")
        .agg(
            F.count("*").alias("n_events"),
            F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"),
        )
    )
    summary = steps.groupBy(F.window(F.window_time("step"), width, step).alias("slot"), "cluster").agg(
        F.sum("n_events").alias("n_events"), F.sum("n_critical").alias("n_critical")
    )
    reach = F.expr(f"interval {reach_minutes} minutes")
    own = F.window("received_at", step)
    # The one sliding window that has the alert's step in its middle.
    middle = F.struct((own["start"] - reach).alias("start"), (own["end"] + reach).alias("end"))
    marked = alerts.withWatermark("received_at", delay).withColumn("slot", middle)
    return (
        marked.join(summary.select("slot", "cluster", "n_events", "n_critical"), ["slot", "cluster"], "left_outer")
        .select(
            "alert_id", "cluster", F.col("slot.start").alias("slot_start"),
            F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("n_critical", F.lit(0)).alias("n_critical"),
        )
    )


def await_approvals(
    requests: DataFrame, decisions: DataFrame, timeout: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """Decision of each approval request, or ``TIMED_OUT`` when none came in time.

    Requests that are undecided and not yet overdue at the end of the input are absent.

    ``requests`` has ``approval_id``, ``requested_at``; ``decisions`` has
    ``approval_id``, ``decided_at``, ``decision``.
    """
    asked = requests.withWatermark("requested_at", delay).alias("q")
    answered = decisions.withWatermark("decided_at", delay).alias("d")
    return asked.join(
        answered,
        F.expr(
            "q.approval_id = d.approval_id AND d.decided_at >= q.requested_at "
            f"AND d.decided_at <= q.requested_at + interval {timeout}"
        ),
        "left_outer",
    ).select(
        "q.approval_id",
        "q.requested_at",
        F.coalesce("d.decision", F.lit("TIMED_OUT")).alias("status"),
    )


class Approvals(StatefulProcessor):
    """The approval requests of one slot: each is pending, then decided or overdue.

    State of a request is its time, its status, and a decision that came before it. It is kept until event time has moved
    ``timeout`` past the request, or past a decision without one, so what arrives twice changes nothing. The requests of a slot
    are read, written and timed together, because each such call costs more than the work on a request.
    """

    def __init__(self, timeout_us: int):
        self.timeout = timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "approvals",
            "open array<struct<id:string,requested:bigint,status:string,decided:bigint,decision:string>>, expires bigint",
        )

    def _fits(self, requested: int, decided: int) -> bool:
        return requested <= decided <= requested + self.timeout

    def _due(self, requested: int | None, decided: int | None) -> int:
        # Milliseconds, the next whole one.
        return -(-((decided if requested is None else requested) + self.timeout) // 1000)

    def _load(self) -> tuple[dict[str, tuple], int | None]:
        found = self.state.get()
        if found is None:
            return {}, None
        return {r[0]: tuple(r[1:]) for r in found[0]}, found[1]

    def _store(self, held: dict[str, tuple], expires: int | None) -> None:
        """Keep the state with a timer for the first request that falls due; ``expires`` is the timer there is."""
        if not held:
            self.state.clear()
            return
        due = min(self._due(requested, decided) for requested, _, decided, _ in held.values())
        if due != expires:
            if expires is not None:
                self.handle.deleteTimer(expires)
            self.handle.registerTimer(due)
        self.state.update(([(name, *values) for name, values in held.items()], due))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, expires = self._load()
        arrived: dict[str, tuple[list, list]] = {}
        for r in rows:
            asked, answers = arrived.setdefault(r["approval_id"], ([], []))
            asked.append(r["at_us"]) if r["decision"] is None else answers.append((r["at_us"], r["decision"]))
        for name, (asked, answers) in arrived.items():
            requested, status, decided, decision = held.get(name, (None, None, None, None))
            if decision is not None:
                answers.append((decided, decision))
            if requested is None and asked:
                requested, status = min(asked), "PENDING"
                yield Row(approval_id=name, status=status, since_us=requested)
            if requested is None:
                decided, decision = max(answers)
            else:
                fitting = sorted(a for a in answers if self._fits(requested, a[0]))
                decided = decision = None
                if status == "PENDING" and fitting:
                    at, status = fitting[0]
                    yield Row(approval_id=name, status=status, since_us=at)
            held[name] = (requested, status, decided, decision)
        self._store(held, expires)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, _ = self._load()
        now, kept = timerValues.getCurrentWatermarkInMs(), {}
        for name, values in held.items():
            requested, status, decided, _ = values
            if self._due(requested, decided) > now:
                kept[name] = values
            elif status == "PENDING":
                yield Row(approval_id=name, status="TIMED_OUT", since_us=requested + self.timeout)
        # The timer that expired is removed by Spark.
        self._store(kept, None)

    def close(self) -> None:
        pass


def approval_states(
    requests: DataFrame, decisions: DataFrame, timeout_minutes: int = 60, delay: str = "10 minutes", slots: int = 16_384
) -> DataFrame:
    """Every state of each approval request as it is reached: (``approval_id``, ``status``, ``since``).

    A request is ``PENDING`` at once, then has the first decision made within ``timeout_minutes``, or is ``TIMED_OUT`` when event
    time has passed that. A decision that arrives before its request waits for it; one made too late or before the request does not
    count. The state of a request is its row with the latest ``since``. Columns are those of ``await_approvals``; rows without an id or time take
    no part. Requests share ``slots`` states by a hash of their id, each rewritten when one of its requests changes: take more where
    many millions are open at a time. It is fixed for the life of a checkpoint. Needs the RocksDB state store.
    """
    asked = requests.select("approval_id", F.col("requested_at").alias("at"), F.lit(None).cast("string").alias("decision"))
    answered = decisions.where("decision IS NOT NULL").select("approval_id", F.col("decided_at").alias("at"), "decision")
    both = asked.unionByName(answered).where("approval_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", delay)
    states = (
        both.withColumn("at_us", F.unix_micros("at"))
        .withColumn("slot", F.pmod(F.xxhash64("approval_id"), F.lit(slots)))
        .groupBy("slot")
        .transformWithState(
            statefulProcessor=Approvals(timeout_minutes * 60_000_000),
            outputStructType="approval_id string, status string, since_us bigint",
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    return states.select("approval_id", "status", F.timestamp_micros("since_us").alias("since"))


def split_late(
    alerts: DataFrame, on_time: str, late: str, allowed: str = "10 minutes", arrived: str = "arrived_at"
):
    """Writer that keeps late alerts aside instead of losing them.

    An alert is late when it arrived more than ``allowed`` after ``received_at``.
    Each batch owns one folder in both tables, so a repeated batch replaces its own
    rows.
    """
    is_late = F.col(arrived) > F.col("received_at") + F.expr(f"interval {allowed}")

    def write(batch: DataFrame, batch_id: int) -> None:
        for path, rows in ((late, batch.where(is_late)), (on_time, batch.where(~is_late))):
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return alerts.writeStream.foreachBatch(write)


def drain(stream: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """Run an append query over everything available now and read the result."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option(
        "path", sink
    ).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(sink)
