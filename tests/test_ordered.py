"""The ordered operators equal a plain scan over each key, hot keys included."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from faultline.operators import ordered

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def small_ranges(spark):
    """Ranges of few rows stay apart, so that there are borders to cross."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def series(spark, n=600, seed=3, nulls=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = rng.choice(["hot", "hot", "hot", "a", "b", None] if nulls else ["hot", "hot", "a"])
        rows.append((i, key, T0 + dt.timedelta(seconds=rng.randrange(0, 40_000) // 7 * 7), rng.random()))
    return rows, spark.createDataFrame(rows, "id int, k string, ts timestamp, v double")


def test_asof_both_directions(spark):
    left, left_df = series(spark, 300, 1)
    right, right_df = series(spark, 200, 2)
    right_df = right_df.select("k", F.col("ts").alias("rts"), F.col("id").alias("rid"))
    for forward in (False, True):
        for tolerance in (None, 300):
            got = {
                r.id: r.rid
                for r in ordered.asof_join(
                    left_df, right_df, ["k"], "ts", "rts", ["rid"], tie="rid",
                    forward=forward, tolerance_seconds=tolerance,
                ).collect()
            }
            assert len(got) == len(left)
            for i, k, ts, _ in left:
                side = [r for r in right if k is not None and r[1] == k
                        and (r[2] >= ts if forward else r[2] <= ts)
                        and (tolerance is None or abs((r[2] - ts).total_seconds()) <= tolerance)]
                if forward:
                    best = min(side, key=lambda r: (r[2], -r[0]), default=None)
                else:
                    best = max(side, key=lambda r: (r[2], r[0]), default=None)
                if best is None:
                    assert got[i] is None
                else:
                    assert right[got[i]][2] == best[2]
                    if not forward:
                        assert got[i] == best[0]


def test_neighbour_and_numbers(spark):
    rows, df = series(spark)
    lag = {r.id: r.p for r in ordered.neighbour(df, ["k"], "ts", "id", {"p": "id"}).collect()}
    lead = {r.id: r.p for r in ordered.neighbour(df, ["k"], "ts", "id", {"p": "id"}, forward=True).collect()}
    number = {r.id: r._n for r in ordered.number_rows(df, ["k"], "ts", "id").collect()}
    for key in {r[1] for r in rows}:
        group = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        for i, r in enumerate(group):
            assert lag[r[0]] == (group[i - 1][0] if i else None)
            assert lead[r[0]] == (group[i + 1][0] if i + 1 < len(group) else None)
            assert number[r[0]] == i


def test_preceding_rows(spark):
    rows, df = series(spark)
    out = ordered.preceding(
        df, ["k"], "ts", "id", 5, {"m": F.avg("v"), "c": F.count("v")}, chunk=7
    ).collect()
    assert len(out) == len(rows)
    got = {r.id: (r.m, r.c) for r in out}
    for key in {r[1] for r in rows}:
        group = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        for i, r in enumerate(group):
            frame = [g[3] for g in group[max(0, i - 5):i]]
            assert got[r[0]][1] == len(frame)
            if frame:
                assert abs(got[r[0]][0] - statistics.fmean(frame)) < 1e-12


def test_running_peak(spark):
    rng = random.Random(9)
    spans = [(rng.choice("hhhab"), rng.randrange(0, 20_000), rng.randrange(1, 4_000)) for _ in range(300)]
    steps = [(k, T0 + dt.timedelta(seconds=s), 1) for k, s, _ in spans]
    steps += [(k, T0 + dt.timedelta(seconds=s + d), -1) for k, s, d in spans]
    df = spark.createDataFrame(steps, "k string, ts timestamp, d int")
    got = {r.k: r.peak for r in ordered.running_peak(df, ["k"], "ts", "d").collect()}
    for key in "hab":
        mine = [(s, s + d) for k, s, d in spans if k == key]
        assert got[key] == max(sum(1 for s, e in mine if s <= t < e) for t, _ in mine)


def test_around(spark):
    marks, marks_df = series(spark, 150, 5, nulls=False)
    items, items_df = series(spark, 500, 6, nulls=False)
    got = {
        r.id: r
        for r in ordered.around(
            marks_df, items_df, ["k"], "id", "ts", "ts", "id", 600, 300,
            {"n": F.lit(True), "big": F.col("v") > 0.5}, F.col("v") > 0.9, ["v"],
        ).collect()
    }
    assert len(got) == len(marks)
    for i, k, ts, _ in marks:
        near = sorted(
            (r for r in items if r[1] == k and -600 <= (r[2] - ts).total_seconds() <= 300),
            key=lambda r: (r[2], r[0]),
        )
        high = [r for r in near if r[3] > 0.9]
        assert (got[i].n, got[i].big) == (len(near), sum(r[3] > 0.5 for r in near))
        assert (got[i]["last"].id if got[i]["last"] else None) == (near[-1][0] if near else None)
        assert (got[i]["first"].id if got[i]["first"] else None) == (high[0][0] if high else None)


def test_a_key_with_nearly_all_rows_in_one_minute(spark):
    """Ranges have about equally many rows, whatever the clock says, and ties are split too."""
    rows = spark.range(40_000).select(
        F.col("id").cast("int").alias("id"),
        F.when(F.col("id") % 20 == 0, F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).otherwise("hot").alias("k"),
        F.timestamp_millis(F.when(F.col("id") % 20 == 0, F.col("id") * 1000).otherwise(F.col("id") % 50)).alias("ts"),
    )
    dealt = ordered._dealt(rows.select("*", ordered._group(["k"])).withColumn("_t", ordered.epoch_us("ts")), "_t", "id")
    sizes = [r["count"] for r in dealt.groupBy("_bucket").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * 40_000 / 8
    got = {r.id: r._n for r in ordered.number_rows(rows, ["k"], "ts", "id").collect()}
    hot = sorted((i % 50, i) for i in range(40_000) if i % 20)
    assert [got[i] for _, i in hot] == list(range(len(hot)))


def test_rows_without_a_time(spark):
    left = spark.createDataFrame([(1, "a", None), (2, "a", T0)], "id int, k string, ts timestamp")
    right = spark.createDataFrame([("a", T0, 5), ("a", None, 6)], "k string, rts timestamp, rid int")
    for forward in (False, True):
        got = {r.id: r.rid for r in ordered.asof_join(left, right, ["k"], "ts", "rts", ["rid"], tie="rid", forward=forward).collect()}
        assert got == {1: None, 2: 5}
