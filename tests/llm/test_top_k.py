"""Exact top-k against all products."""

import math
import random

import pytest

from faultline.llm import top_k
from pyspark.sql import functions as F


def plain(rows, k):
    points = [
        (v, [math.floor(256 * x) for x in e])
        for v, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)
    ]
    out = []
    for i, (q, p) in enumerate(points):
        if q is None or q % 50:
            continue
        scores = [(-sum(a * b for a, b in zip(p, c, strict=True)), v is None, v) for j, (v, c) in enumerate(points)
                  if j != i and len(c) == len(p)]
        out += [(q, r, v, -s) for r, (s, _, v) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def check(spark, rows, k=5):
    table = spark.createDataFrame([(v, e, 1) for v, e in rows], "vec_id long, embedding array<double>, row int").repartition(3)
    points = table.where(top_k.usable("embedding")).select("vec_id", top_k.scaled("embedding").alias("point"))
    got = top_k.top_k(points, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), k)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, k)


@pytest.mark.parametrize("dim, spread", [(3, 1.0), (16, 1.0), (8, 1e5)])
def test_matches_all_products(spark, dim, spread, monkeypatch):
    # Workers get the tree functions by reference, so only the dealing is made small.
    monkeypatch.setattr(top_k, "SHARD_ROWS", 300)
    monkeypatch.setattr(top_k, "QUERY_ROWS", 7)
    rng = random.Random(dim)
    check(spark, [(k, [rng.gauss(0, spread) for _ in range(dim)]) for k in range(1500)])


def test_ties_and_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SHARD_ROWS", 200)
    rng = random.Random(1)
    check(spark, [(k, [1.0, 0.5] if k % 3 else [rng.choice([0.0, 1.0, -1.0]), 1.0]) for k in range(1000)])


def test_edge_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, 1.0]), (50, [0.0, -1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]),
            (4, [float("inf"), 0.0]), (100, [1.0]), (5, [2.0]), (150, []), (7, []), (None, [1.0, 2.0]), (200, [1.0, 2.0, 3.0]),
            (-50, [0.00390625, -0.001])]
    check(spark, rows)
    check(spark, rows, k=1)


def test_large_components_do_not_fail(spark):
    rows = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 2.0])], "vec_id long, embedding array<double>")
    points = rows.select("vec_id", top_k.scaled("embedding").alias("point"))
    assert [r.vec_id for r in top_k.top_k(points, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]


def test_empty_table(spark):
    rows = spark.createDataFrame([], "vec_id long, point array<double>")
    assert top_k.top_k(rows, F.col("vec_id") % 50 == 0).count() == 0
