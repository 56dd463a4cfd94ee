"""Streams over several batches, against the batch result or by hand."""

import datetime as dt

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import TimerValues

from faultline.streaming import alerts as ops

T0 = dt.datetime(2024, 1, 1, 12)
ALERT = "alert_id string, cluster string, dag_id string, task_id string, run_id string, try_number int, received_at timestamp"


def alert(i, run, minute, try_number=1):
    return (f"a{i}", "c", "d", "t", run, try_number, T0 + dt.timedelta(minutes=minute))


def batches(spark, path, schema, *parts):
    """Each part becomes one file and, with one file per trigger, one batch."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream, tmp_path):
    return ops.drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))


def test_stream_equals_batch(spark, tmp_path):
    schema = "log_text string, state string, attempt int, operator string, code string, requested_memory int"
    texts = ["oomkilled", "429", "column x not found", "fine", "division by zero", "sensor has timed out"]
    parts = [[(t, "failed", n, "K8s", "INSERT INTO t", 0) for t in texts] for n in (1, 2, 3)]
    got = drain(ops.decide(batches(spark, str(tmp_path / "in"), schema, *parts)), tmp_path)
    want = ops.decide(spark.createDataFrame([r for p in parts for r in p], schema))
    cols = ["log_text", "attempt", "failure_category", "can_auto_remediate", "remediation_action", "route"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_dedup_inside_and_outside_the_delay(spark, tmp_path):
    stream = batches(
        spark, str(tmp_path / "in"), ALERT,
        [alert(1, "r1", 0), alert(2, "r1", 1), alert(3, "r2", 2)],
        [alert(4, "r1", 30), alert(5, "r1", 31, try_number=2)],
        [alert(6, "r9", 300)],  # moves the watermark on
        [alert(7, "r8", 301)],  # expired state goes at the end of this batch
        [alert(8, "r1", 302)],
    )
    got = [r.run_id + str(r.try_number) for r in drain(ops.deduplicate(stream), tmp_path).collect()]
    assert sorted(got) == ["r11", "r11", "r12", "r21", "r81", "r91"]


def test_retry_budget_across_batches(spark, tmp_path):
    stream = batches(
        spark, str(tmp_path / "in"), ALERT,
        [alert(1, "r1", 0), alert(2, "r2", 0)],
        [alert(3, "r1", 10, 2), alert(4, "r1", 20, 3)],
        [alert(5, "r1", 30, 4)],
        [alert(6, "r8", 60 * 40)],  # moves event time past the day a run is kept
        [alert(7, "r8", 60 * 40 + 1)],
        [alert(8, "r1", 60 * 40 + 2)],
    )
    got = {r.alert_id: (r.retry, r.allowed) for r in drain(ops.retry_budget(stream), tmp_path).collect()}
    assert got == {
        "a1": (1, True), "a2": (1, True), "a3": (2, True), "a4": (3, False), "a5": (4, False),
        "a6": (1, True), "a7": (2, True), "a8": (1, True),
    }


def test_sessions(spark, tmp_path):
    stream = batches(
        spark, str(tmp_path / "in"), ALERT,
        [alert(1, "r", 0), alert(2, "r", 29, 2)],
        [alert(3, "r", 58, 3), alert(4, "r", 120)],
        [alert(5, "r", 600)],
    )
    got = sorted((r.n_alerts, r.last_try) for r in drain(ops.incident_sessions(stream), tmp_path).collect())
    assert got == [(1, 1), (3, 3)]


def test_approvals_time_out(spark, tmp_path):
    requests = batches(
        spark, str(tmp_path / "q"), "approval_id string, requested_at timestamp",
        [("x", T0), ("y", T0), ("z", T0)], [("end", T0 + dt.timedelta(hours=9))],
    )
    decisions = batches(
        spark, str(tmp_path / "d"), "approval_id string, decision string, decided_at timestamp",
        [("x", "APPROVED", T0 + dt.timedelta(minutes=5)), ("y", "REJECTED", T0 + dt.timedelta(minutes=90))],
        [("none", "APPROVED", T0 + dt.timedelta(hours=9))],
    )
    got = {r.approval_id: r.status for r in drain(ops.await_approvals(requests, decisions), tmp_path).collect()}
    assert got == {"x": "APPROVED", "y": "TIMED_OUT", "z": "TIMED_OUT"}


ASKED, ANSWERED = "approval_id string, requested_at timestamp", "approval_id string, decision string, decided_at timestamp"


def test_approval_states_over_a_restart(spark, tmp_path):
    """Pending is visible, an early decision waits, and state outlives the query that wrote it."""
    asked, answered = str(tmp_path / "q"), str(tmp_path / "d")
    minute = lambda m: T0 + dt.timedelta(minutes=m)

    def states(*name):
        rows = drain(ops.approval_states(*name), tmp_path).collect()
        out = {}
        for r in sorted(rows, key=lambda r: r.since):
            out.setdefault(r.approval_id, []).append((r.status, r.since))
        return out

    requests = batches(spark, asked, ASKED, [("x", minute(0)), ("y", minute(0)), ("z", minute(1)), (None, minute(1)), ("x", minute(2))])
    decisions = batches(spark, answered, ANSWERED, [("early", "APPROVED", minute(6)), ("w", "REJECTED", minute(1)), ("y", None, minute(3))])
    first = states(requests, decisions)
    assert first == {"x": [("PENDING", minute(0))], "y": [("PENDING", minute(0))], "z": [("PENDING", minute(1))]}
    more = spark.createDataFrame([("early", minute(5)), ("w", minute(4))], ASKED)
    more.coalesce(1).write.mode("append").parquet(asked)
    late = [("x", "REJECTED", minute(5)), ("x", "APPROVED", minute(9)), ("z", "APPROVED", minute(62))]
    spark.createDataFrame(late, ANSWERED).coalesce(1).write.mode("append").parquet(answered)
    second = states(spark.readStream.schema(ASKED).parquet(asked), spark.readStream.schema(ANSWERED).parquet(answered))
    assert second["x"] == [("PENDING", minute(0)), ("REJECTED", minute(5))]
    assert second["early"] == [("PENDING", minute(5)), ("APPROVED", minute(6))]
    assert second["w"] == [("PENDING", minute(4))]
    spark.createDataFrame([("end", minute(600))], ASKED).coalesce(1).write.mode("append").parquet(asked)
    third = states(spark.readStream.schema(ASKED).parquet(asked), spark.readStream.schema(ANSWERED).parquet(answered))
    assert third["y"] == [("PENDING", minute(0)), ("TIMED_OUT", minute(60))]
    assert third["z"][-1] == ("TIMED_OUT", minute(61)) and third["w"][-1] == ("TIMED_OUT", minute(64))
    assert third["end"] == [("PENDING", minute(600))] and third["x"] == second["x"] and third["early"] == second["early"]


def test_approvals_of_a_slot_share_their_calls():
    """Requests of a slot cost one read, one write and one timer together, and those not yet due stay."""
    calls, kept = [], {}

    class Handle:
        def getValueState(self, *_):
            return self

        def get(self):
            calls.append("get")
            return kept.get("value")

        def update(self, value):
            calls.append("update")
            kept["value"] = value

        def clear(self):
            calls.append("clear")
            kept.clear()

        def registerTimer(self, at):
            calls.append(("timer", at))

        def deleteTimer(self, at):
            calls.append(("gone", at))

    def row(name, at, decision=None):
        return Row(approval_id=name, at_us=at * 1_000_000, decision=decision)

    def mark(second):
        return TimerValues(0, second * 1000)

    slot = ops.Approvals(60_000_000)
    slot.init(Handle())
    first = [row(f"a{i}", i) for i in range(100)] + [row("a7", 9, "APPROVED"), row("early", 50, "REJECTED"), row("a3", 200, "APPROVED")]
    got = [(r.approval_id, r.status) for r in slot.handleInputRows((0,), iter(first), mark(0))]
    assert sorted(got) == sorted([(f"a{i}", "PENDING") for i in range(100)] + [("a7", "APPROVED")])
    assert calls == ["get", ("timer", 60_000), "update"]
    calls.clear()
    got = [(r.approval_id, r.status) for r in slot.handleInputRows((0,), iter([row("early", 45), row("a7", 9, "REJECTED")]), mark(0))]
    assert got == [("early", "PENDING"), ("early", "REJECTED")] and calls == ["get", "update"]
    calls.clear()
    due = [(r.approval_id, r.status, r.since_us // 1_000_000) for r in slot.handleExpiredTimer((0,), mark(109), None)]
    assert sorted(due) == sorted((f"a{i}", "TIMED_OUT", i + 60) for i in range(50) if i != 7)
    assert calls == ["get", ("timer", 110_000), "update"]
    calls.clear()
    assert len([*slot.handleExpiredTimer((0,), mark(1000), None)]) == 50
    assert calls == ["get", "clear"]


def test_approvals_do_not_depend_on_their_slots(spark, tmp_path):
    minute = lambda m: T0 + dt.timedelta(minutes=m)
    asked = [(f"r{i}", minute(i)) for i in range(30)] + [("r3", minute(5)), (None, minute(1)), ("r4", None), ("end", minute(95))]
    answered = [(f"r{i}", "REJECTED" if i % 2 else "APPROVED", minute(i + 7 * i % 90)) for i in range(0, 30, 2)] + [("lone", "APPROVED", minute(2))]
    got = []
    for slots in (1, 3, 16_384):
        folder = tmp_path / str(slots)
        folder.mkdir()
        streams = batches(spark, str(folder / "q"), ASKED, asked), batches(spark, str(folder / "d"), ANSWERED, answered)
        rows = drain(ops.approval_states(*streams, slots=slots), folder).collect()
        got.append(sorted(map(tuple, rows)))
    assert got[0] == got[1] == got[2] and {r[1] for r in got[0]} == {"PENDING", "APPROVED", "TIMED_OUT"}


def test_late_alerts_are_kept(spark, tmp_path):
    schema = ALERT + ", arrived_at timestamp"
    rows = [(*alert(i, "r", 0), T0 + dt.timedelta(minutes=m)) for i, m in enumerate((0, 10, 11, 300))]
    stream = batches(spark, str(tmp_path / "in"), schema, rows[:2], rows[2:])
    on_time, late = str(tmp_path / "on"), str(tmp_path / "late")
    writer = ops.split_late(stream, on_time, late).option("checkpointLocation", str(tmp_path / "cp"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert {r.alert_id for r in spark.read.parquet(on_time).collect()} == {"a0", "a1"}
    assert {r.alert_id for r in spark.read.parquet(late).collect()} == {"a2", "a3"}


EVENT = "cluster string, ts timestamp, severity string"


def at(minute, second=0):
    return T0 + dt.timedelta(minutes=minute, seconds=second)


def test_correlation_crosses_borders_and_keeps_lonely_alerts(spark, tmp_path):
    alerts = batches(
        spark, str(tmp_path / "alerts"), ALERT,
        [alert(1, "r1", 10), alert(2, "r2", 100)], [alert(3, "r3", 300)], [alert(4, "r4", 301)],
    )
    events = batches(
        spark, str(tmp_path / "events"), EVENT,
        # A second before the alert's own step, at both ends of the reach, and beyond them.
        [("c", at(9, 59), "CRITICAL"), ("c", at(0), "INFO"), ("c", at(20, 59), "INFO"), ("c", at(21), "INFO"), ("d", at(10), "INFO")],
        [("c", at(300), "INFO")], [("c", at(301), "INFO")],
    )
    got = {r.alert_id: (r.n_events, r.n_critical) for r in drain(ops.correlate(alerts, events), tmp_path).collect()}
    assert got == {"a1": (3, 1), "a2": (0, 0)}


def test_saturation_over_batches(spark, tmp_path):
    schema = "cluster string, pod_name string, ts timestamp, value double"
    usage = batches(
        spark, str(tmp_path / "in"), schema,
        [("c", "p", at(0), 5.0), ("c", "p", at(1), 95.0)], [("c", "p", at(2), 96.0), ("c", "q", at(2), 10.0)],
        [("c", "p", at(60), 1.0)], [("c", "p", at(61), 1.0)],
    )
    got = {(r.window_start, r.peak, r.samples) for r in drain(ops.saturation_alarms(usage, 90.0), tmp_path).collect()}
    want = set()
    for start in range(-4, 3):
        inside = [v for m, v in ((0, 5.0), (1, 95.0), (2, 96.0)) if start <= m < start + 5]
        if max(inside) > 90:
            want.add((at(start), max(inside), len(inside)))
    assert got == want


def test_retry_budget_counts_repeats_once(spark, tmp_path):
    stream = batches(spark, str(tmp_path / "in"), ALERT, [alert(1, "r1", 0), alert(1, "r1", 0), alert(2, "r1", 5)], [alert(2, "r1", 5), alert(3, "r1", 9)])
    got = sorted((r.alert_id, r.retry, r.allowed) for r in drain(ops.retry_budget(stream), tmp_path).collect())
    assert got == [("a1", 1, True), ("a2", 2, True), ("a3", 3, False)]
