"""Objects read and written by their keys."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from faultline import session
from faultline.sources import lake, objects

ROWS = [
    ("c 1", "d%41", "t", "2026-01-02T11:00:00+00:00", 1, "one\ntwo"),
    ("c 1", "d%41", "t", "2026-01-02T11:00:00+00:00", 2, "second"),
    ("c 1", "d%41", "t", "2026-01-03T11:00:00+00:00", 10, "newest"),
    ("c 1", "d%41", "t", "2026-01-03T11:00:00+00:00", 9, "older"),
    ("c2", "e", "u", "2026-01-01", 1, "é"),
    ("c2", "e", "v", "2026-01-01", 1, ""),
]
SCHEMA = "cluster string, dag_id string, task_id string, execution_date string, attempt int, content string"


@pytest.fixture
def root(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, SCHEMA).withColumn("key", objects.log_key())
    objects.write_objects(rows, f"file://{tmp_path}/lake")
    return f"file://{tmp_path}/lake"


def files(root):
    return sorted(objects.Store(root).below(""))


def test_objects_stand_at_their_keys(root):
    assert files(root) == sorted(
        f"cluster={c}/dag_id={d}/task_id={t}/execution_date={e}/attempt={n}.log" for c, d, t, e, n, _ in ROWS
    )
    store = objects.Store(root)
    assert store.read("cluster=c2/dag_id=e/task_id=u/execution_date=2026-01-01/attempt=1.log") == "é".encode()


def test_filters_name_the_objects(spark, root):
    logs = objects.read_logs(spark, root)
    assert sorted((r.cluster, r.dag_id, r.attempt, r.log_text) for r in logs.collect()) == sorted((r[0], r[1], r[4], r[5]) for r in ROWS)
    one = logs.where("cluster = 'c 1' AND dag_id = 'd%41' AND task_id = 't' AND execution_date = '2026-01-03T11:00:00+00:00' AND attempt = 9")
    assert [r.log_text for r in one.collect()] == ["older"]
    some = logs.where(F.col("cluster").isin("c2", "c9") & (F.col("attempt") == 1))
    assert sorted(r.log_text for r in some.collect()) == ["", "é"]
    assert logs.where("cluster = 'none'").count() == 0


class Counting(objects.Store):
    opened: list = []
    listed: list = []

    def read(self, key):
        self.opened.append(key)
        return super().read(key)

    def below(self, folder):
        self.listed.append(folder)
        return super().below(folder)


def test_only_what_is_asked_for_is_opened(root, monkeypatch):
    monkeypatch.setattr(objects, "Store", Counting)
    Counting.opened, Counting.listed = [], []
    reader = objects.LogReader(root)
    asked = {"cluster": "c2", "dag_id": "e", "task_id": "u", "execution_date": "2026-01-01", "attempt": 1}
    assert len(list(reader.pushFilters([objects.EqualTo((n,), v) for n, v in asked.items()]))) == 5
    [partition] = reader.partitions()
    assert [r[0] for r in reader.read(partition)] == ["é"]
    assert len(Counting.opened) == 1 and Counting.listed == []
    reader = objects.LogReader(root)
    list(reader.pushFilters([objects.EqualTo(("cluster",), "c2"), objects.In(("attempt",), (1, 5)), objects.EqualTo(("task_id",), "v")]))
    [partition] = reader.partitions()
    assert Counting.listed == ["cluster=c2"] and len(partition.value) == 1


def test_lookup_by_address(spark, root):
    asked = [
        ("a", "c 1", "d%41", "t", "2026-01-02T11:00:00+00:00", 2), ("b", "c 1", "d%41", "t", "2026-01-02T11:00:00+00:00", 7),
        ("c", "c2", "e", "none", "2026-01-01", 1), ("d", None, "e", "u", "2026-01-01", 1), ("e", "c2", "e", "u", None, None),
        ("f", "c 1", "d%41", "t", "2026-01-02T11:00:00+00:00", 2), ("g", "c2", "e", "v", "2026-01-01", 1),
    ]
    requests = spark.createDataFrame(asked, "id string, cluster string, dag_id string, task_id string, execution_date string, attempt int")
    got = {r.id: (r.log_text, r.log_found) for r in objects.lookup_objects(requests, root).collect()}
    assert got == {
        "a": ("second", True), "b": ("newest", True), "c": (None, False), "d": (None, False), "e": ("é", True),
        "f": ("second", True), "g": ("", True),
    }
    assert objects.lookup_objects(requests.limit(0), root).count() == 0


def test_addresses_agree_with_the_listing(spark, root):
    folder = root.removeprefix("file://")
    scanned = {r.uri for r in lake.scan_task_logs(spark, folder).collect()}
    listed = {r.path for r in lake.list_objects(spark, folder).collect()}
    assert {u.removeprefix("file:").lstrip("/") for u in scanned} == {u.removeprefix("file:").lstrip("/") for u in listed}
    assert any("d%41" in u and "c 1" in u for u in scanned)


def test_sync_leaves_equal_objects_alone(spark, root):


    base = Path(root.removeprefix("file://"))
    before = {p: p.stat().st_ino for p in base.rglob("*.log")}
    changed = [(*r[:5], "SECOND" if r[5] == "second" else r[5] + "!" if r[5] == "older" else r[5]) for r in ROWS]
    rows = spark.createDataFrame([*changed, ("c3", "n", "n", "2026", 1, "new")], SCHEMA).withColumn("key", objects.log_key())
    objects.write_objects(rows, root, changed_only=True)
    after = {p: p.stat().st_ino for p in base.rglob("*.log")}
    assert len(after) == len(before) + 1
    assert sorted(p.read_text() for p in before if after[p] != before[p]) == ["SECOND", "older!"]
    assert not [p for p in base.rglob("*") if p.name.startswith((".", "_"))]


def test_a_failed_write_leaves_nothing(spark, root):
    before = files(root)
    rows = spark.range(40).select(
        F.when(F.col("id") == 39, "../out").otherwise(F.concat(F.lit("new/"), F.col("id").cast("string"))).alias("key"), F.lit("x").alias("content")
    ).repartition(4)
    with pytest.raises(Exception, match="not a key below the root"):
        objects.write_objects(rows, root)
    assert files(root) == before


def test_scratch_is_removed(spark):
    folder = session.scratch_dir(spark, "probe")
    spark.range(3).write.parquet(folder)
    store = objects.Store(session.shared_root(spark))
    assert store.below(folder.removeprefix(session.shared_root(spark) + "/"))
    kept, session._HANDED_OUT[:] = session._HANDED_OUT[:-1], [folder]
    session.clear_scratch(spark)
    session._HANDED_OUT[:] = kept
    assert not store.below(folder.removeprefix(session.shared_root(spark) + "/"))
