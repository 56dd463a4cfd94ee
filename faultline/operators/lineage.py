"""Model lineage: closure, blast radius and broken column contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.operators.columns import column_references
from faultline.operators.walks import closure, walk


def lineage_closure(edges: DataFrame) -> DataFrame:
    """All (``node``, ``ancestor``) pairs with the shortest distance ``depth``.

    ``edges`` has ``node`` and ``parent``.
    """
    kind = edges.schema["node"].dataType.simpleString()
    return closure(edges, "node", "parent", kind).withColumnsRenamed({"a": "node", "b": "ancestor"})


def blast_radius(edges: DataFrame, broken: DataFrame) -> DataFrame:
    """For each broken node: how many nodes depend on it, directly or not, and how
    far the damage reaches.

    The walk starts from the broken nodes, so only what lies below them is visited.
    Broken nodes on which nothing depends are absent.
    """
    kind = edges.schema["node"].dataType.simpleString()
    roots = broken.select(F.col("node").alias("parent")).distinct()
    start = edges.join(roots, "parent").select(F.col("parent").alias("a"), F.col("node").alias("b")).distinct()
    reached = walk(start, edges, "parent", "node", kind)
    return reached.groupBy(F.col("a").alias("node")).agg(
        F.count("*").alias("n_downstream"), F.max("depth").alias("reach")
    )


# What a failed run says about a column.
RENAME_HINT = r"""HINT:.*?"(\w+)\.(\w+)\""""
MISSING_HINT = r"""column "(\w+)" does not exist in relation "(\w+)\""""


def contract_breaks(nodes: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """Columns that models take from an upstream model which no longer declares
    them, with the likely new name.

    ``nodes`` has ``name``, ``raw_code`` and ``columns`` (array of names; models
    without any are not judged). A hint in a run ``message`` names the new column,
    otherwise it is the declared column with the smallest edit distance, columns the
    model already takes coming last.
    """
    used = column_references(nodes)
    declared = nodes.where("size(columns) > 0").groupBy(F.lower("name").alias("upstream")).agg(
        F.first(F.transform("columns", F.lower)).alias("columns")
    )
    taken = used.groupBy("node", "upstream").agg(F.collect_set("column").alias("taken"))
    missing = used.where("NOT is_declared").select("node", "upstream", "column")
    # Declared columns stay in their array.
    broken = missing.join(declared, "upstream").join(taken, ["node", "upstream"])
    nearest = F.array_min(
        F.transform(
            "columns",
            lambda c: F.struct(
                F.array_contains("taken", c).alias("known"),
                F.levenshtein(c, F.col("column")).alias("d"),
                c.alias("c"),
            ),
        )
    )["c"]
    if messages is None:
        return broken.select("node", "upstream", "column", nearest.alias("rename_to"))
    hints = (
        messages.select(
            F.lower(F.regexp_extract("message", MISSING_HINT, 2)).alias("upstream"),
            F.lower(F.regexp_extract("message", MISSING_HINT, 1)).alias("column"),
            F.lower(F.regexp_extract("message", RENAME_HINT, 2)).alias("_hint"),
        )
        .where("column <> '' AND _hint <> ''")
        .groupBy("upstream", "column")
        .agg(F.min("_hint").alias("_hint"))
    )
    return broken.join(hints, ["upstream", "column"], "left").select(
        "node", "upstream", "column", F.coalesce("_hint", nearest).alias("rename_to")
    )
