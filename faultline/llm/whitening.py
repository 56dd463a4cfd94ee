"""Whitening of vectors with distributed block matrices.

Rows are numbered without gaps, centred, and dealt to the blocks of an MLlib ``BlockMatrix``. The transposed
blocks times the blocks give the scatter matrix, which is as large as the square of the
dimension and is decomposed on the driver. The blocks times the whitening matrix give the
projected rows, and the transposed product of these shows how far their covariance is
from the identity.

Vectors are whole numbers here, so the mean is exact: a centred entry is ``(n * x - S) / n``
with an exact numerator. Vectors of different lengths are different spaces, whitened one after
the other; empty vectors have no component. A component without variance (an eigenvalue that rounding alone explains)
has a null ``whitened`` and explains 0; the identity is then meant over the others. Equal vectors get equal
rows, repeated or null ids stay rows of their own, and other columns are not read. No
usable vector gives an empty table. Entries or sums beyond a long raise an error of Spark.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.shared import written

# Rows of a block, and blocks whose products one task adds up.
BLOCK_ROWS = 1024
BLOCKS_PER_TASK = 64
COMPONENTS = 32


def usable(vector: str) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    return F.expr(f"`{vector}` IS NOT NULL AND forall(`{vector}`, c -> c IS NOT NULL AND abs(c) < double('infinity'))")


def steps(vector: str, scale: int = 64, shift: int = 1_000_000) -> Column:
    """Entries in whole steps of ``1 / scale``, moved by ``shift``."""
    return F.transform(F.col(f"`{vector}`"), lambda c: F.floor(c.cast("double") * scale).cast("long") + shift)


def _numbered(points: DataFrame) -> DataFrame:
    """Rows with ``index`` from 0 without gaps: the place in the task that wrote a row, after the rows of all tasks before."""
    rows = written(
        points.withColumns({"_task": F.spark_partition_id(), "_nth": F.monotonically_increasing_id() % (1 << 33)}),
        "whitening-points",
    )
    # One row per task.
    tasks = rows.groupBy("_task").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_task")) - F.col("_rows")
    tasks = tasks.select("_task", before.alias("_before"))
    return rows.join(tasks, "_task").withColumn("index", F.col("_before") + F.col("_nth")).drop("_task", "_nth", "_before")


def _product(left: BlockMatrix, right: BlockMatrix, inner_blocks: int) -> BlockMatrix:
    """``left`` times ``right``, the inner dimension split over tasks.

    The Python class has no parameter for the split, without which all blocks would meet in one task, so the method
    behind it is called.
    """
    splits = max(1, -(-inner_blocks // BLOCKS_PER_TASK))
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def _vectors(matrix: BlockMatrix) -> DataFrame:
    """The rows of a block matrix as (``index``, ``values``), without leaving the JVM."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    rows = MLUtils.convertVectorColumnsToML(rows.toDF("index", "vector"), "vector")
    return rows.select("index", vector_to_array("vector").alias("values"))


def _deviation(exact: str) -> Column:
    """Sum of squares of whole numbers, exact."""
    zero = F.lit(0).cast("decimal(38,0)")
    return F.aggregate(exact, zero, lambda a, v: (a + v.cast("decimal(19,0)") * v.cast("decimal(19,0)")).cast("decimal(38,0)"))


def _whiten_space(points: DataFrame, dim: int, components: int) -> DataFrame:
    """Whitening of vectors that all have ``dim`` entries."""
    spark = points.sparkSession
    rows = _numbered(points)
    sums = rows.select(F.posexplode("point").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    totals = sorted(sums.collect())
    n, blocks_high = totals[0].n, -(-totals[0].n // BLOCK_ROWS)
    by_dimension = F.array(*[F.lit(t.s).cast("long") for t in totals])
    centred = rows.withColumn("exact", F.zip_with("point", by_dimension, lambda x, s: x * F.lit(n).cast("long") - s))
    vectors = centred.select("index", array_to_vector(F.transform("exact", lambda v: v / F.lit(float(n)))).alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, dim)
    blocks = matrix.toBlockMatrix(BLOCK_ROWS, dim)
    scatter = _product(blocks.transpose(), blocks, blocks_high).toLocalMatrix().toArray()
    covariance = (scatter + scatter.T) / (2.0 * n)
    values, axes = np.linalg.eigh(covariance)
    values, axes = np.maximum(values[::-1], 0.0), axes[:, ::-1]
    # The largest entry of an axis is positive, so runs agree.
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(dim)] < 0, -1.0, 1.0)
    width = min(components, dim)
    real = values[:width] > dim * np.finfo(float).eps * values[0]
    scale = np.zeros(width)
    scale[real] = 1.0 / np.sqrt(values[:width][real])
    trace = float(np.trace(covariance))
    whitener = DenseMatrix(dim, width, (axes[:, :width] * scale).ravel(order="F"))
    one_block = spark.sparkContext.parallelize([((0, 0), whitener)], 1)
    projected = blocks.multiply(BlockMatrix(one_block, dim, width, dim, width))
    spread = _product(projected.transpose(), projected, blocks_high).toLocalMatrix().toArray() / n
    off = np.abs(spread - np.eye(width))[np.ix_(real, real)]
    facts = F.array(
        *[
            F.struct(
                F.lit(k + 1).cast("int").alias("component"),
                F.lit(bool(real[k])).alias("real"),
                F.lit(float(values[k] / trace) if real[k] else 0.0).alias("explained"),
            )
            for k in range(width)
        ]
    )
    wide = centred.select("index", "id", _deviation("exact").alias("deviation")).join(_vectors(projected), "index")
    long = wide.select("id", "deviation", F.inline(F.arrays_zip(facts.alias("fact"), F.col("values").alias("value"))))
    return long.select(
        "id",
        F.col("fact.component").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(F.col("fact.real"), F.col("value")).alias("whitened"),
        F.col("fact.explained").alias("explained"),
        F.lit(float(off.max(initial=0.0))).alias("identity_error"),
    )


def whiten(points: DataFrame, id_column: str, point: str, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: ``id_column``, ``component``, ``n``, ``deviation`` (decimal), ``whitened``,
    ``explained`` and ``identity_error``.

    ``point`` holds arrays of longs. All vectors fit and all are projected.
    """
    points = points.select(F.col(id_column).alias("id"), F.col(point).alias("point"))
    lengths = [r.dim for r in points.groupBy(F.size("point").alias("dim")).count().where("dim > 0").orderBy("dim").collect()]
    out = None
    for dim in lengths:
        rows = _whiten_space(points.where(F.size("point") == dim), dim, components)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        kind = points.schema["id"].dataType.simpleString()
        out = points.sparkSession.createDataFrame(
            [],
            f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double",
        )
    return out.withColumnRenamed("id", id_column)


def report(embeddings: DataFrame) -> DataFrame:
    """Whitening of all usable embeddings in steps of 1/64, the deviation as a long."""
    rows = embeddings.where(usable("embedding")).select("vec_id", steps("embedding").alias("point"))
    return whiten(rows, "vec_id", "point").withColumn("deviation", F.col("deviation").cast("long"))
