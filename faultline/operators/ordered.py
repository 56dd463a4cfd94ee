"""Ordered computations that stay parallel when one key holds most rows.

A plain window over ``PARTITION BY key`` sorts each key in one task. Here rows are dealt to ranges of (key, time, tie) with
about equally many rows, which are written to the shared scratch folder with the number of their range, so a key
with very many rows, in whatever span of time, becomes many ranges. Rows are windowed per key and range, and
what must cross a border travels in a table with one row per key and range. Results
equal those of the plain window. Sources are read once to be sampled for the borders and once to be dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.session import scratch_dir


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``_bucket``: the number of the range of (``_k``, order) in which a row lies. Written, so it stays."""
    spark = rows.sparkSession
    path = scratch_dir(spark, "ranges")
    ranged = rows.repartitionByRange("_k", *order).withColumn("_bucket", F.spark_partition_id())
    ranged.write.parquet(path)
    return spark.read.schema(ranged.schema).parquet(path)


def _group(keys: list[str]) -> Column:
    """The keys as one struct: null keys form a group, and the join on the struct
    reuses the partitioning of the window."""
    return F.struct(*keys).alias("_k")


def _join_edges(rows: DataFrame, edges: DataFrame) -> DataFrame:
    return rows.join(edges, ["_k", "_bucket"], "left")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    values: list[str],
    tie: str | None = None,
    forward: bool = False,
    tolerance_seconds: int | None = None,
) -> DataFrame:
    """Attach to each left row the nearest right row in time, per key.

    Backward (default): the last right row at or before ``left_ts``; forward: the
    first at or after it. ``tie`` orders right rows of equal time. ``values`` are
    right columns; they are null when nothing matches or the match lies further
    away than ``tolerance_seconds``. Every left row appears exactly once.
    """
    sign = -1 if forward else 1
    sample = F.struct(
        epoch_us(right_ts).alias("_at"), *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)]
    )
    side_left = left.select(
        _group(keys),
        epoch_us(left_ts).alias("_t"),
        F.lit(1).alias("_side"),
        F.lit(None).cast(right.schema[tie].dataType if tie else "int").alias("_tie"),
        F.struct(*left.columns).alias("_row"),
    )
    side_right = right.where(" AND ".join(f"{k} IS NOT NULL" for k in [*keys, right_ts])).select(
        _group(keys),
        epoch_us(right_ts).alias("_t"),
        F.lit(0).alias("_side"),
        (F.col(tie) if tie else F.lit(None).cast("int")).alias("_tie"),
        sample.alias("_sample"),
    )
    # At the same time a left row lies behind the right ones, seen in the direction of the search.
    both = side_left.unionByName(side_right, allowMissingColumns=True).withColumn("_place", F.col("_side") * sign)
    both = _dealt(both, "_t", "_place", "_tie").withColumn("_order", F.col("_t") * sign)
    inside = (
        Window.partitionBy("_k", "_bucket")
        .orderBy("_order", "_side", *(["_tie"] if not forward else [F.desc("_tie")]))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    near = both.withColumn("_near", F.last("_sample", ignorenulls=True).over(inside)).where(
        "_side = 1"
    )
    nearest = F.max if not forward else F.min
    edges = both.groupBy("_k", "_bucket").agg(
        nearest(F.when(F.col("_side") == 0, F.struct("_t", "_tie", "_sample"))).alias("_edge")
    )
    before = Window.partitionBy("_k").orderBy(F.col("_bucket") * sign).rowsBetween(
        Window.unboundedPreceding, -1
    )
    edges = edges.select(
        "_k", "_bucket", F.last("_edge._sample", ignorenulls=True).over(before).alias("_far")
    )
    hit = F.when(F.col("_t").isNotNull(), F.coalesce("_near", "_far"))
    if tolerance_seconds is not None:
        gap = F.abs(hit["_at"] - F.col("_t"))
        hit = F.when(gap <= tolerance_seconds * 1_000_000, hit)
    return _join_edges(near, edges).select(
        "_row.*", *[hit[f"_v{i}"].alias(v) for i, v in enumerate(values)]
    )


def neighbour(
    rows: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    values: dict[str, str],
    forward: bool = False,
) -> DataFrame:
    """``lag`` (or with ``forward`` ``lead``) by one row per key, in (ts, tie) order.

    ``values`` maps new column names to the columns they copy.
    """
    sign = -1 if forward else 1
    rows = _dealt(rows.select("*", _group(keys)).withColumn("_t", epoch_us(ts)), "_t", tie)
    copied = F.struct(*[F.col(source).alias(name) for name, source in values.items()])
    order = [F.col("_t"), F.col(tie)]
    inside = Window.partitionBy("_k", "_bucket").orderBy(*[c.desc() if forward else c for c in order])
    near = rows.withColumn("_near", F.lag(copied).over(inside))
    edge = F.min if forward else F.max
    edges = rows.groupBy("_k", "_bucket").agg(
        edge(F.struct("_t", F.col(tie).alias("_tie"), copied.alias("_copied"))).alias("_edge")
    )
    step = Window.partitionBy("_k").orderBy(F.col("_bucket") * sign)
    edges = edges.select("_k", "_bucket", F.lag("_edge._copied").over(step).alias("_far"))
    joined = _join_edges(near, edges)
    found = F.coalesce("_near", "_far")
    return joined.select(
        *[c for c in rows.columns if c not in ("_k", "_t", "_bucket")],
        *[found[name].alias(name) for name in values],
    )


def number_rows(
    rows: DataFrame, keys: list[str], ts: str, tie: str, weight: str | None = None
) -> DataFrame:
    """Add ``_n``: the row number per key in (ts, tie) order, counted from 0, or with
    ``weight`` the sum of that column over the rows before."""
    each = F.col(weight) if weight else F.lit(1)
    rows = _dealt(rows.select("*", _group(keys)).withColumn("_t", epoch_us(ts)), "_t", tie)
    inside = Window.partitionBy("_k", "_bucket").orderBy("_t", tie)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum(each).over(earlier), F.lit(0)))
    before = Window.partitionBy("_k").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_k", "_bucket")
        .agg(F.sum(each).alias("_size"))
        .select(
            "_k", "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
        )
    )
    return (
        _join_edges(local, offsets)
        .withColumn("_n", F.col("_offset") + F.col("_local"))
        .drop("_k", "_t", "_bucket", "_local", "_offset")
    )


def preceding(
    rows: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    n: int,
    aggregates: dict[str, Column],
    chunk: int = 50_000,
) -> DataFrame:
    """Aggregates over the ``n`` rows before each row, per key in (ts, tie) order.

    Rows are numbered, cut into chunks of equal length, and the last ``n`` rows of
    each chunk are repeated as a lead-in of the next one.
    """
    if chunk < n:
        raise ValueError("chunk must hold at least n rows")
    numbered = number_rows(rows, keys, ts, tie)
    own = F.floor(F.col("_n") / chunk)
    in_tail = F.col("_n") % chunk >= chunk - n
    placed = numbered.withColumn(
        "_chunk", F.explode(F.when(in_tail, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    frame = Window.partitionBy(*keys, "_chunk").orderBy("_n").rowsBetween(-n, -1)
    return (
        placed.select("*", *[agg.over(frame).alias(name) for name, agg in aggregates.items()])
        .where(F.col("_chunk") == own)
        .drop("_n", "_chunk")
    )


def preceding_where(
    rows: DataFrame,
    condition: Column,
    keys: list[str],
    ts: str,
    tie: str,
    n: int,
    aggregates: dict[str, Column],
    chunk: int = 50_000,
) -> DataFrame:
    """Aggregates over the last ``n`` rows before each row for which ``condition`` holds.

    Rows learn how many such rows came before them. Those that hold carry the
    aggregates up to and with themselves under the next number, and every row looks up
    its own number; rows before the first one get nulls.
    """
    holds = F.coalesce(condition, F.lit(False))
    numbered = number_rows(
        rows.withColumn("_holds", holds.cast("int")), keys, ts, tie, weight="_holds"
    )
    held = numbered.where("_holds = 1")
    own = F.floor(F.col("_n") / chunk)
    in_tail = F.col("_n") % chunk >= chunk - n
    placed = held.withColumn(
        "_chunk", F.explode(F.when(in_tail, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    frame = Window.partitionBy(*keys, "_chunk").orderBy("_n").rowsBetween(1 - n, 0)
    summed = (
        placed.select(_group(keys), "_n", "_chunk", *[agg.over(frame).alias(name) for name, agg in aggregates.items()])
        .where(F.col("_chunk") == own)
        .select("_k", (F.col("_n") + 1).alias("_n"), *aggregates)
    )
    return numbered.select("*", _group(keys)).join(summed, ["_k", "_n"], "left").drop("_k", "_n", "_holds")


def running_peak(
    steps: DataFrame, keys: list[str], ts: str, delta: str
) -> DataFrame:
    """Highest running total of ``delta`` per key, in time order.

    Steps at the same instant are summed first, so only totals between instants
    count.
    """
    instants = _dealt(steps.groupBy(_group(keys), epoch_us(ts).alias("_t")).agg(F.sum(delta).alias("_d")), "_t")
    inside = Window.partitionBy("_k", "_bucket").orderBy("_t").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    per_bucket = (
        instants.withColumn("_run", F.sum("_d").over(inside))
        .groupBy("_k", "_bucket")
        .agg(F.max("_run").alias("_peak"), F.sum("_d").alias("_net"))
    )
    before = Window.partitionBy("_k").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("_net").over(before), F.lit(0))
    return (
        per_bucket.withColumn("_level", base + F.col("_peak"))
        .groupBy("_k")
        .agg(F.max("_level").alias("peak"))
        .select("_k.*", "peak")
    )


def around(
    marks: DataFrame,
    items: DataFrame,
    keys: list[str],
    mark_id: str,
    mark_ts: str,
    item_ts: str,
    item_id: str,
    before_seconds: int,
    after_seconds: int,
    counts: dict[str, Column],
    first_where: Column,
    values: list[str],
) -> DataFrame:
    """Summary of the items in ``[t - before, t + after]`` around each mark, without
    forming mark-item pairs.

    Returns ``mark_id``, one count per condition in ``counts``, ``first`` (struct of
    ``values`` of the first item where ``first_where`` holds) and ``last`` (of the
    last item). A count is the difference of two running counts and the two items
    are the nearest ones seen from the ends of the interval, so the work is one
    shuffle and two sorts, however many items lie around a mark.
    """
    names = list(counts)
    value = F.struct(epoch_us(item_ts).alias("_at"), item_id, *values)
    item_rows = items.where(" AND ".join(f"{k} IS NOT NULL" for k in [*keys, item_ts])).select(
        _group(keys),
        epoch_us(item_ts).alias("_t"),
        F.lit(1).alias("_rank"),
        F.col(item_id).alias("_tie"),
        value.alias("_item"),
        F.when(first_where, value).alias("_hit"),
        *[F.when(cond, 1).otherwise(0).alias(f"_c_{name}") for name, cond in counts.items()],
    )
    ends = F.explode(
        F.array(
            F.struct(
                (epoch_us(mark_ts) - before_seconds * 1_000_000).alias("_t"), F.lit(0).alias("_rank")
            ),
            F.struct(
                (epoch_us(mark_ts) + after_seconds * 1_000_000).alias("_t"), F.lit(2).alias("_rank")
            ),
        )
    )
    mark_rows = marks.select(_group(keys), F.col(mark_id).alias("_mark"), ends.alias("_end")).select(
        "_k",
        "_mark",
        "_end._t",
        "_end._rank",
        *[F.lit(0).alias(f"_c_{name}") for name in names],
    )
    both = _dealt(mark_rows.unionByName(item_rows, allowMissingColumns=True), "_t", "_rank", "_tie")
    span = (Window.unboundedPreceding, Window.currentRow)
    inside = Window.partitionBy("_k", "_bucket")
    onward = inside.orderBy("_t", "_rank", "_tie").rowsBetween(*span)
    backward = inside.orderBy(F.desc("_t"), F.desc("_rank"), F.desc("_tie")).rowsBetween(*span)
    near = both.select(
        "_k",
        "_bucket",
        "_mark",
        "_t",
        "_rank",
        F.last("_item", ignorenulls=True).over(onward).alias("_last"),
        F.last("_hit", ignorenulls=True).over(backward).alias("_next"),
        *[F.sum(f"_c_{name}").over(onward).alias(f"_r_{name}") for name in names],
    ).where("_rank <> 1")
    edges = both.groupBy("_k", "_bucket").agg(
        F.max("_item").alias("_item"),
        F.min("_hit").alias("_hit"),
        *[F.sum(f"_c_{name}").alias(f"_s_{name}") for name in names],
    )
    outside = (Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_k").orderBy("_bucket").rowsBetween(*outside)
    later = Window.partitionBy("_k").orderBy(F.desc("_bucket")).rowsBetween(*outside)
    edges = edges.select(
        "_k",
        "_bucket",
        F.last("_item", ignorenulls=True).over(earlier).alias("_far_last"),
        F.last("_hit", ignorenulls=True).over(later).alias("_far_next"),
        *[
            F.coalesce(F.sum(f"_s_{name}").over(earlier), F.lit(0)).alias(f"_o_{name}")
            for name in names
        ],
    )
    sign = F.when(F.col("_rank") == 2, 1).otherwise(-1)
    seen = (
        _join_edges(near, edges)
        .groupBy(F.col("_mark").alias(mark_id))
        .agg(
            F.min("_t").alias("_from"),
            F.max("_t").alias("_to"),
            F.max(F.when(F.col("_rank") == 2, F.coalesce("_last", "_far_last"))).alias("_last"),
            F.max(F.when(F.col("_rank") == 0, F.coalesce("_next", "_far_next"))).alias("_next"),
            *[
                F.sum(sign * (F.col(f"_r_{name}") + F.col(f"_o_{name}"))).alias(name)
                for name in names
            ],
        )
    )

    def kept(column: str, condition: Column) -> Column:
        return F.when(condition, F.struct(*[F.col(f"{column}.{c}") for c in [item_id, *values]]))

    return seen.select(
        mark_id,
        *names,
        kept("_next", F.col("_next._at") <= F.col("_to")).alias("first"),
        kept("_last", F.col("_last._at") >= F.col("_from")).alias("last"),
    )
