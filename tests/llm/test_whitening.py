"""Whitening, against a dense computation and in odd rows."""

import numpy as np
import pytest

from faultline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string"


def table(spark, vectors, ids=None):
    rows = [(k if ids is None else ids[k], None if v is None else [None if x is None else float(x) for x in v], "x") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def dense(vectors, width):
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    exact = len(x) * x - x.sum(axis=0)
    centred = exact / len(x)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    values, axes = values[::-1], axes[:, ::-1]
    return centred @ axes[:, :width] / np.sqrt(values[:width]), values / values.sum(), [int(v) for v in (exact.astype(object) ** 2).sum(axis=1)]


@pytest.mark.parametrize("rows, dim", [(300, 40), (2500, 5)])
def test_against_dense(spark, rows, dim):
    rng = np.random.default_rng(dim)
    vectors = (rng.normal(size=(rows, dim)) @ rng.normal(size=(dim, dim))).astype(np.float32)
    got = whitening.report(table(spark, vectors).repartition(4)).toPandas()
    width = min(dim, 32)
    white, share, deviation = dense(vectors, width)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert wide.shape == white.shape
    signs = np.sign((wide * white).sum(axis=0))
    assert np.abs(wide * signs - white).max() < 1e-8
    first = got[got.component == 1].sort_values("vec_id")
    assert first.deviation.tolist() == deviation and (got.n == rows).all()
    assert np.allclose(got[got.vec_id == 0].sort_values("component").explained, share[:width], rtol=1e-9)
    covariance = np.cov(wide.T, bias=True).reshape(width, width)
    assert np.abs(covariance - np.eye(width)).max() < 1e-8 and (got.identity_error < 1e-8).all()


def test_odd_rows(spark):
    vectors = [None, [1, None], [float("nan"), 1], [float("inf"), 0], [], [1, 2], [3, 5], [0, 1], [0, 1], [1, 2, 3], [2, 2, 2]]
    ids = [0, 1, 2, 3, 4, 5, None, 7, 7, 9, 10]
    got = whitening.report(table(spark, vectors, ids)).collect()
    assert sorted((r.vec_id, r.component) for r in got if r.vec_id is not None and r.vec_id < 9) == [(5, 1), (5, 2), (7, 1), (7, 1), (7, 2), (7, 2)]
    assert sum(r.vec_id is None for r in got) == 2
    assert len({r.whitened for r in got if r.vec_id == 7 and r.component == 1}) == 1
    # Two vectors of three entries span one direction: the rest has no variance.
    three = {(r.vec_id, r.component): r for r in got if r.vec_id in (9, 10)}
    assert len(three) == 6 and {r.n for r in three.values()} == {2}
    assert abs(abs(three[(9, 1)].whitened) - 1) < 1e-9 and three[(9, 2)].whitened is None and three[(9, 3)].explained == 0.0
    assert abs(three[(9, 1)].explained - 1) < 1e-9


def test_equal_vectors(spark):
    got = whitening.report(table(spark, [[1, 2]] * 5)).collect()
    assert len(got) == 10 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 for r in got)


def test_no_rows(spark):
    for vectors in ([], [None, []]):
        got = whitening.report(table(spark, vectors))
        assert got.collect() == [] and got.schema["deviation"].dataType.simpleString() == "bigint"


def test_work_is_split(spark):
    """Blocks of a long matrix meet in several tasks."""
    rows = spark.range(200_000).selectExpr("id as vec_id", "array(cast(id % 7 as float), cast(id % 11 as float)) as embedding")
    got = whitening.report(rows)
    first = got.first()
    assert first.n == 200_000 and first.identity_error < 1e-9
    assert got.count() == 400_000
