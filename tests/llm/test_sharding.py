"""Shards by rendezvous: weights, growth, places, odd rows."""

import hashlib
import math
import zlib
from collections import Counter

import pytest

from faultline.llm import sharding


def best(key, weights):
    def draw(s):
        u = (int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        return weights[s] / -math.log(u)

    return max(range(len(weights)), key=lambda s: (draw(s), -s))


def placed(spark, weights, added=None, count=4000):
    rows = spark.range(count).withColumnRenamed("id", "doc_id")
    return {r.doc_id: r for r in sharding.place(rows, "doc_id", weights, added).collect()}


def test_against_plain_code(spark):
    weights = [1.0, 3.0, 0.5]
    got = placed(spark, weights, 2.0)
    assert all(r.shard == best(k, weights) and r.grown_shard == best(k, [*weights, 2.0]) for k, r in got.items())


def test_weights_and_growth(spark):
    got = placed(spark, [1.0, 2.0, 4.0, 1.0], 2.0, 20_000)
    shares = Counter(r.shard for r in got.values())
    for shard, share in enumerate((1 / 8, 2 / 8, 4 / 8, 1 / 8)):
        assert abs(shares[shard] / 20_000 - share) < 0.015
    moved = [r for r in got.values() if r.shard != r.grown_shard]
    assert all(r.grown_shard == 4 for r in moved) and abs(len(moved) / 20_000 - 0.2) < 0.015


def test_weights_must_be_positive(spark):
    for weights in ([], [1.0, 0.0]):
        with pytest.raises(ValueError):
            sharding.draws(sharding.F.lit("a"), weights)


def test_report(spark):
    rows = [(k, f"text {k}", None) for k in range(300)]
    rows += [(7, "text 7", "x")] * 900 + [(None, None, "x")] * 500 + [(None, "", None), (8, None, "y"), (9, "é" * 100_000, "y"), (7, "other", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    got = sharding.report(docs, shards=4).collect()
    want = Counter(
        (k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", best("" if k is None else k, [1.0] * 4))
        for k, t, _ in rows
    )
    assert Counter(tuple(r)[:5] for r in got) == want
    for shard in range(4):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    # Places follow the digest of the key.
    order = [hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest() for r in sorted(got, key=lambda r: r.slot) if r.shard == 2]
    assert order == sorted(order)
    again = sharding.report(docs.repartition(3), shards=4).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_no_rows(spark):
    assert sharding.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = sharding.report(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_written_shards(spark, tmp_path):
    rows = spark.range(500).selectExpr("id as doc_id", "repeat('x', 10) as text")
    sharding.write_shards(sharding.place(rows, "doc_id", [1.0] * 3), f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == 500 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}
