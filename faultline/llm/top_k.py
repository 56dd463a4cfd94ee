"""Exact top-k by inner product over KD-trees.

Vectors are dealt to shards of bounded size by a hash of their row. Each shard is built
once into a KD-tree: median splits along the widest side down to small leaves,
each with the tight box of its points and its smallest id, and written as one row.
Queries are packed into blocks. A block visits a shard by joining their rows: for each query the leaves
come in order of the largest product any point of their box could have, and the visit
ends when that bound falls below the k-th best score. Blocks visit a first shard, and the
k-th scores found there go along to all others, where most boxes fail at once.

Null vectors, and vectors with a null, NaN or infinite component, take no part. Vectors
are compared with those of their own length. Rows with equal ids are different rows:
only the query's own row is left out. Ties go to the smaller id, null last. Scores beyond the
range of a long are cut to it, and computed in doubles. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.shared import written

SHARD_ROWS = 16_384
QUERY_ROWS = 1_024
LEAF_ROWS = 128
_LAST = np.iinfo(np.int64).max
NONE = np.iinfo(np.int64).min
# Sums below this are exact in doubles.
_EXACT = float(1 << 53)


class Tree:
    """Points of a shard in the order of the leaves, and the boxes of the leaves."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, points: np.ndarray):
        order = np.arange(len(ids))
        cuts, work = [], [(0, len(ids))]
        while work:
            start, end = work.pop()
            if end - start <= LEAF_ROWS or not points.shape[1]:
                cuts.append(start)
                continue
            own = points[order[start:end]]
            side = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            half = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(own[:, side], half)]
            work += [(start, start + half), (start + half, end)]
        self.begin = np.array(sorted(cuts), np.int64)
        self.ids, self.rows, self.points = ids[order], rows[order], points[order]
        self.low = np.minimum.reduceat(self.points, self.begin, axis=0)
        self.high = np.maximum.reduceat(self.points, self.begin, axis=0)
        self.least = np.minimum.reduceat(self.ids, self.begin)

    def pack(self) -> dict[str, bytes]:
        return {n: getattr(self, n).tobytes() for n in _PARTS}

    @classmethod
    def unpack(cls, row: dict, dim: int) -> Tree:
        tree = cls.__new__(cls)
        for name, kind in _PARTS.items():
            value = np.frombuffer(row[name], kind)
            setattr(tree, name, value.reshape(-1, dim) if kind is np.float64 and dim else value)
        if not dim:
            for name in ("points", "low", "high"):
                setattr(tree, name, np.zeros((len(tree.ids if name == "points" else tree.begin), 0)))
        return tree

    def products(self, queries: np.ndarray):
        """A function for whole products of some queries with points, exact where a long holds them."""
        reach = np.abs(self.points).max(initial=0) * np.abs(queries).max(initial=0) * max(1, queries.shape[1])
        if reach < _EXACT:
            return lambda a, b: (a @ b.T).astype(np.int64)
        if reach < float(1 << 62):
            return lambda a, b: a.astype(np.int64) @ b.astype(np.int64).T
        edge = 2.0**63 - 1024
        return lambda a, b: np.clip(np.nan_to_num(a @ b.T), -edge, edge).astype(np.int64)

    def search(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
        """The best k of each query: scores, ids and row numbers; scores of NONE where there are fewer.

        ``floor`` holds scores that the k-th best of the whole search cannot fall below.
        """
        count = len(queries)
        top = np.full((count, k), NONE)
        ids, rows = np.full((count, k), _LAST), np.full((count, k), -1)
        product = self.products(queries)
        bound = product(np.maximum(queries, 0), self.high) + product(np.minimum(queries, 0), self.low)
        order = np.argsort(~bound, axis=1, kind="stable")
        active = np.arange(count)
        ends = np.append(self.begin[1:], len(self.ids))
        for step in range(len(self.begin)):
            leaf = order[active, step]
            reached, kth = bound[active, leaf], np.maximum(top[active, -1], floor[active])
            # Later leaves have smaller bounds, so a query that fails here is done.
            going = reached >= kth
            active, leaf, reached = active[going], leaf[going], reached[going]
            if not len(active):
                break
            # A leaf that can only tie is of use if it has a smaller id.
            useless = (reached == top[active, -1]) & (self.least[leaf] > ids[active, -1])
            for one in np.unique(leaf[~useless]):
                who = active[(leaf == one) & ~useless]
                span = slice(self.begin[one], ends[one])
                score = product(queries[who], self.points[span])
                score[self.rows[span][None, :] == own[who][:, None]] = NONE
                width = (len(who), score.shape[1])
                scores = np.hstack([top[who], score])
                named = np.hstack([ids[who], np.broadcast_to(self.ids[span], width)])
                placed = np.hstack([rows[who], np.broadcast_to(self.rows[span], width)])
                best = np.lexsort((placed, named, ~scores), axis=-1)[:, :k]
                for into, values in ((top, scores), (ids, named), (rows, placed)):
                    into[who] = np.take_along_axis(values, best, axis=1)
        return top, ids, rows


_PARTS = {
    "begin": np.int64, "ids": np.int64, "rows": np.int64, "points": np.float64,
    "low": np.float64, "high": np.float64, "least": np.int64,
}


def usable(vector: str) -> Column:
    """Whether a vector takes part."""
    return F.expr(f"{vector} IS NOT NULL AND forall({vector}, x -> x IS NOT NULL AND abs(x) < double('infinity'))")


def scaled(vector: str, scale: int = 256) -> Column:
    """Each component times ``scale``, rounded down, as a double that holds a whole number."""
    return F.transform(F.col(vector), lambda x: _floor(x, scale))


def _floor(x: Column, scale: int) -> Column:
    # floor() gives a long and fails beyond its range, where doubles are whole anyway.
    y = x.cast("double") * scale
    return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), dim)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_LAST).to_numpy().astype(np.int64)


def _build(rows: pa.Table) -> pa.Table:
    dim = rows.column("dim")[0].as_py()
    tree = Tree(_ids(rows.column("vec_id")), rows.column("row").to_numpy(), _matrix(rows.column("point"), dim))
    packed = {n: pa.array([v], pa.binary()) for n, v in tree.pack().items()}
    return pa.table({"dim": rows.column("dim").slice(0, 1), "shard": rows.column("shard").slice(0, 1), **packed})


def _pack(rows: pa.Table) -> pa.Table:
    dim = rows.column("dim")[0].as_py()
    return pa.table(
        {
            "dim": rows.column("dim").slice(0, 1),
            "block": rows.column("block").slice(0, 1),
            "own": pa.array([rows.column("row").to_numpy().tobytes()], pa.binary()),
            "queries": pa.array([_matrix(rows.column("point"), dim).tobytes()], pa.binary()),
        }
    )


_FOUND = "row long, vec_id long, other long, score long, bound long"


def _visit(cells: DataFrame, k: int) -> DataFrame:
    """Results of blocks in the shards they are joined with; ``bound`` is the k-th score there."""

    def run(batches):
        for batch in batches:
            # One cell at a time: a cell holds a whole shard.
            for at in range(batch.num_rows):
                cell = {n: batch.column(n)[at].as_py() for n in batch.schema.names}
                own, dim = np.frombuffer(cell["own"], np.int64), cell["dim"]
                queries = np.frombuffer(cell["queries"], np.float64).reshape(len(own), dim)
                floor = np.frombuffer(cell["floor"], np.int64) if cell["floor"] else np.full(len(own), NONE)
                top, ids, rows = Tree.unpack(cell, dim).search(queries, own, floor, k)
                real = top > NONE
                who, found = np.nonzero(real)[0], ids[real]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own[who]),
                        pa.array([None if i == _LAST else i for i in found.tolist()], pa.int64()),
                        pa.array(rows[real]),
                        pa.array(top[real]),
                        pa.array(top[who, -1]),
                    ],
                    names=["row", "vec_id", "other", "score", "bound"],
                )

    names = ["dim", "own", "queries", "floor", *_PARTS]
    return cells.select(*names).mapInArrow(run, _FOUND)


def _parts(rows: DataFrame, size: int) -> DataFrame:
    """Number of parts of about ``size`` rows, one row per vector length.

    Written, so that Spark knows its size when it plans the join with the vectors.
    """
    return written(rows.groupBy("dim").count().select("dim", F.expr(f"1 + count div {size}").alias("parts")), "parts")


def _dealt(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows with a part number, by vector length, such that parts hold about ``size`` rows."""
    return rows.join(_parts(rows, size), "dim").withColumn(name, F.expr("pmod(xxhash64(row), parts)"))


def top_k(vectors: DataFrame, asked: Column, k: int = 5) -> DataFrame:
    """For each row of ``vectors`` where ``asked`` holds, the k other rows with the largest products.

    ``vectors`` has vec_id and ``point``, an array of whole numbers. Columns: query_id,
    rank (from 1), vec_id, score.
    """
    rows = vectors.select("vec_id", "point", F.size("point").alias("dim"), asked.alias("asked"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    parts = ", ".join(f"{n} binary" for n in _PARTS)
    trees = written(
        _dealt(rows, SHARD_ROWS, "shard").select("dim", "shard", "vec_id", "row", "point")
        .groupBy("dim", "shard").applyInArrow(_build, f"dim int, shard long, {parts}"),
        "trees",
    )
    blocks = written(
        _dealt(rows.where("asked"), QUERY_ROWS, "block").select("dim", "block", "row", "point")
        .groupBy("dim", "block").applyInArrow(_pack, "dim int, block long, own binary, queries binary"),
        "queries",
    )
    visits = blocks.join(_parts(rows, SHARD_ROWS), "dim").withColumn("home", F.expr("block % parts"))
    first = visits.withColumn("shard", F.col("home")).withColumn("floor", F.lit(None).cast("binary"))
    found = written(_visit(first.join(trees, ["dim", "shard"]), k), "home")
    # The k-th scores of a block, in the order of its queries.
    known = found.groupBy("row").agg(F.max("bound").alias("bound"))
    rest = _floors(visits, known).withColumn("shard", F.explode(F.expr("sequence(0L, parts - 1)"))).where("shard <> home")
    later = _visit(rest.join(trees, ["dim", "shard"]), k)
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other")
    ranked = found.unionByName(later).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = rows.where("asked").select("row", F.col("vec_id").alias("query_id"))
    return ranked.join(names, "row").select("query_id", "rank", "vec_id", "score")


def _floors(visits: DataFrame, known: DataFrame) -> DataFrame:
    """Blocks with the k-th scores known of their queries, NONE where none is."""

    def listed(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                own = np.frombuffer(batch.column("own")[at].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(own), batch.column("dim")[at].as_py()), pa.int32()),
                        pa.array(np.full(len(own), batch.column("block")[at].as_py()), pa.int64()),
                        pa.array(own), pa.array(np.arange(len(own))),
                    ],
                    names=["dim", "block", "row", "place"],
                )

    def packed(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("place").to_numpy())
        floor = rows.column("bound").fill_null(NONE).to_numpy()[order]
        return pa.table(
            {
                "dim": rows.column("dim").slice(0, 1), "block": rows.column("block").slice(0, 1),
                "floor": pa.array([floor.astype(np.int64).tobytes()], pa.binary()),
            }
        )

    places = visits.select("dim", "block", "own").mapInArrow(listed, "dim int, block long, row long, place long")
    floors = places.join(known, "row", "left").groupBy("dim", "block").applyInArrow(
        packed, "dim int, block long, floor binary"
    )
    return visits.join(floors, ["dim", "block"])
