"""Near-duplicate documents by the Jaccard similarity of their word n-grams.

Two sets with similarity t or more share t of the larger one, so whatever order all
tokens are put in, they share a token among the first n - ceil(t n) + 1 of each. The join
uses this for several orders at once:

1. The order of the hashes. Of each set its first tokens, a quarter of it, are counted
   over the corpus. A set whose share of tokens seen in another set is too small to
   be similar to anything leaves here, which is most of an ordinary corpus.
2. The sets that stay are counted whole. Tokens no other set has cannot match, so they
   count as the head of every order and only the rest of a prefix is kept, rarest
   token first. Shared tokens of this order give the candidate pairs.
3. Two more orders, by independent hashes of the tokens, over the same shared tokens.
   A candidate pair must share a prefix token in each of them, and sizes must fit, before
   its sets are compared.

Equal sets are one node. Within the documents of one token all pairs would be too many, so each
is first compared with the nodes of the token that have most and least in common with
the corpus. Then only pairs between different components are left to compare, and all
these are that share a token in prefixes as short as the sizes of both allow. The
links found this way connect exactly what all links connect.

Null texts and texts without words have an empty set, link with nothing and are their
own component. Repeated rows give equal rows; rows with one id and different texts are
nodes of their own. Extra columns are not read. Nodes are 64-bit hashes of sets of 64-bit
hashes; a collision would be needed between two compared sets to matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.components import components
from faultline.llm.shared import LOWER, Block, blocks, discard, lists, mix, runs, signed, slice_hashes, written

WORDS = 5
PERCENT = 80
# One token in so many more than a prefix needs is counted, and must be shared.
SPARE = 16
# Of the orders by hash.
SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def _needed(n: int, percent: int) -> int:
    """Tokens that a set of n shares with every set similar to it."""
    return -(-percent * n // 100)


def _spare(n: int) -> int:
    """Tokens by which the counted head of a set is longer than its prefix."""
    return n // SPARE


def sets(block: Block, words: int) -> list[np.ndarray]:
    """The sorted different n-gram hashes of each text of a block."""
    data = LOWER[block.data]
    starts, ends, first = block.words()
    hashes = slice_hashes(data, starts, ends)
    grams, _, begin = runs(hashes, first, words)
    out = []
    for k in range(len(first) - 1):
        if first[k + 1] - first[k] >= words:
            out.append(np.unique(grams[begin[k] : begin[k + 1]]))
            continue
        # A shorter text is one n-gram, told apart from others by its length.
        whole = np.zeros(min(1, first[k + 1] - first[k]), np.uint64)
        for j, h in enumerate(hashes[first[k] : first[k + 1]]):
            whole = mix(whole * np.uint64(31) + h + np.uint64(j + 1))
        out.append(whole)
    return out


def _node(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def heads(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, node, n_shingles and the head of the set in hash order."""

    def run(batches):
        for block in blocks(batches):
            found = sets(block, words)
            size = [len(s) for s in found]
            cut = [min(n, n - _needed(n, percent) + 1 + _spare(n)) for n in size]
            head = np.concatenate([s[:c] for s, c in zip(found, cut, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [
                    block.rows.column("doc_id"),
                    block.rows.column("text_hash"),
                    pa.array([_node(s) for s in found], pa.int64()),
                    pa.array(size, pa.int64()),
                    lists(signed(head), np.array(cut)),
                ],
                names=["doc_id", "text_hash", "node", "n_shingles", "head"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, f"doc_id {kind}, text_hash long, node long, n_shingles long, head array<long>"
    )


def _whole_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, n and the whole set of each node, from the document that stands for it."""
    # The same join at every size, so that a run on a part foretells the whole.
    wanted = nodes.select(F.col("doc_id").alias("chosen"), "node").hint("merge")
    chosen = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("chosen")))

    def run(batches):
        for block in blocks(batches):
            found = sets(block, words)
            want = block.rows.column("node").to_pylist()
            # An id with several texts brings them all; each node takes its own.
            keep = [s for s, node in zip(found, want, strict=True) if _node(s) == node]
            if keep:
                size = np.array([len(s) for s in keep])
                nodes = pa.array([_node(s) for s in keep], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [nodes, pa.array(size), lists(signed(np.concatenate(keep)), size)], names=["node", "n", "tokens"]
                )

    return chosen.select("text", "node").mapInArrow(run, "node long, n long, tokens array<long>")


def _shared(rows: DataFrame) -> DataFrame:
    """Tokens that different nodes have, with the number of rows that have them.

    A written table: joined with a grouping of its own key, the rows of a token that very
    many nodes have could not be split over tasks; joined with a table, they are.
    """
    return written(
        rows.groupBy("token")
        .agg(F.count("*").alias("df"), F.min("node").alias("least"), F.max("node").alias("most"))
        .where("least < most").select("token", "df"),
        "shared",
    )


def _needed_sql(n: str, percent: int) -> Column:
    return F.expr(f"({percent} * {n} + 99) div 100")


def _prefixes(whole: DataFrame, percent: int) -> DataFrame:
    """node, n, the number of shared tokens, and the prefix of each set under three orders of them.

    The shared tokens of a node arrive one after the other, so a task holds those of
    one node and of one batch.
    """
    rows = whole.select("node", "n", F.explode("tokens").alias("token"))
    counted = rows.join(_shared(rows), "token").select("node", "n", "token", "df")

    def ends(node: int, n: int, token: np.ndarray, df: np.ndarray):
        # Rows that are there more than once bring their tokens again.
        token, first = np.unique(token, return_index=True)
        length = len(token) - _needed(n, percent) + 1
        if length > 0:
            orders = (np.argsort(df[first], kind="stable"), *[np.argsort(mix(token ^ np.uint64(seed))) for seed in SEEDS])
            return node, n, len(token), *[token[order[:length]] for order in orders]
        return None

    def run(batches):
        names, kept = ("node", "n", "token", "df"), None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in names]
            if kept is not None:
                columns = [np.concatenate(pair) for pair in zip(kept, columns, strict=True)]
            border = np.flatnonzero(np.diff(columns[0])) + 1
            last = border[-1] if len(border) else 0
            kept = [c[last:] for c in columns]
            yield from made([c[:last] for c in columns], border[:-1])
        if kept is not None:
            yield from made(kept, np.zeros(0, np.int64))

    def made(columns, border):
        if not len(columns[0]):
            return
        node, n, token, df = columns
        starts = np.append(0, border)
        parts = zip(starts.tolist(), np.append(border, len(node)).tolist(), strict=True)
        found = [ends(int(node[a]), int(n[a]), token[a:b].view(np.uint64), df[a:b]) for a, b in parts]
        found = [f for f in found if f is not None]
        if found:
            plain = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            size = np.array([len(f[3]) for f in found])
            arrays = [lists(signed(np.concatenate([f[k] for f in found])), size) for k in (3, 4, 5)]
            yield pa.RecordBatch.from_arrays(plain + arrays, names=["node", "n", "shared", "rare", "second", "third"])

    return counted.repartition("node").sortWithinPartitions("node").mapInArrow(
        run, "node long, n long, shared long, rare array<long>, second array<long>, third array<long>"
    )


def _verified(pairs: DataFrame, prefixes: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, after the filters of the other orders."""

    def side(df: DataFrame, key: str, *columns: str) -> DataFrame:
        return df.select(F.col("node").alias(key), *[F.col(c).alias(f"{key}_{c}") for c in columns])

    orders = ("second", "third")
    likely = pairs.join(side(prefixes, "a", *orders), "a").join(side(prefixes, "b", *orders), "b")
    for order in orders:
        likely = likely.where(F.arrays_overlap(f"a_{order}", f"b_{order}"))
    likely = likely.select("a", "b")
    both = likely.join(side(whole, "a", "tokens"), "a").join(side(whole, "b", "tokens"), "b")
    return (
        both.select("a", "b", F.size(F.array_intersect("a_tokens", "b_tokens")).alias("common"),
                    (F.size("a_tokens") + F.size("b_tokens")).alias("total"))
        .where(f"100 * common >= {percent} * (total - common)")
        .select("a", "b").distinct()
    )


def _needed_both(percent: int) -> Column:
    """Tokens that sets of sizes a_n and b_n share if they are similar."""
    return F.expr(f"({percent} * (a_n + b_n) + {99 + percent}) div {100 + percent}")


def _can_share(percent: int) -> Column:
    """Whether two sets have enough shared tokens for each other."""
    return F.least("a_shared", "b_shared") >= _needed_both(percent)


def _prefixes_meet(percent: int) -> Column:
    """Whether a common token lies in the prefix of both sets that their sizes call for."""
    needed = _needed_both(percent)
    return (F.col("a_place") <= F.col("a_shared") - needed) & (F.col("b_place") <= F.col("b_shared") - needed)


def _ordered_pair() -> tuple[Column, Column]:
    return F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")


def links(prefixes: DataFrame, whole: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between similar nodes that connect all nodes which any links connect."""
    parts = ["node", "n", "shared"]
    rows_ = rows = written(prefixes.select(*parts, F.posexplode("rare").alias("place", "token")), "rows")
    # Most likely to be close to all others: the set with the largest share of shared tokens.
    whole_share = F.struct((F.col("shared") / F.col("n")).alias("share"), *parts)
    ends = (
        rows.groupBy("token")
        .agg(F.max(whole_share).alias("high"), F.min(whole_share).alias("low"), F.min("node").alias("least"),
             F.max("node").alias("most"))
        .where("least < most").select("token", F.explode(F.array("high", "low")).alias("end"))
    )
    ends = written(ends, "ends")
    near = (
        rows.join(ends.select("token", *[F.col(f"end.{c}").alias(f"b_{c}") for c in parts]), "token")
        .select(*[F.col(c).alias(f"a_{c}") for c in parts], *[f"b_{c}" for c in parts])
        .where((F.col("a_node") != F.col("b_node")) & _can_share(percent))
        .select(*_ordered_pair()).distinct()
    )
    first = written(_verified(near, prefixes, whole, percent), "first")
    named = components(first)
    rows = rows.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = written(
        rows.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most"))
        .where("least < most").select("token"),
        "split",
    )
    open_rows = written(rows.join(split, "token", "left_semi"), "open")
    sides = [open_rows.select("token", *[F.col(c).alias(f"{k}_{c}") for c in (*parts, "place", "component")]) for k in "ab"]
    across = (
        sides[0].join(sides[1], "token")
        .where((F.col("a_component") < F.col("b_component")) & _prefixes_meet(percent))
        .select(*_ordered_pair()).distinct()
    )
    last = written(_verified(across, prefixes, whole, percent), "across")
    discard(rows_, ends, split, open_rows)
    return first.union(last)


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Every row's doc_id, text_hash, n_shingles, and component with its smallest id; null for empty sets."""
    heads_ = written(heads(docs, words, percent), "heads")
    ids = written(heads_.select("doc_id", "text_hash", "node", "n_shingles"), "ids")
    rows = heads_.select("node", F.explode("head").alias("token"))
    hits = rows.join(_shared(rows).select("token"), "token", "left_semi").groupBy("node").agg(F.count("*").alias("hits"))
    nodes = ids.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.count("*").alias("copies")
    )
    # The smallest set that is similar has at least this many shared tokens in its head. Each
    # copy of a set has counted all its hits.
    least = F.least(F.expr(f"1 + (({percent} * n + 99) div 100) div {SPARE}"), _needed_sql("n", percent))
    alive = nodes.join(hits, "node").where(F.col("hits") >= least * F.col("copies")).select("node", "doc_id")
    alive = written(alive, "alive")
    discard(heads_)
    whole = written(_whole_sets(docs, alive, words), "sets")
    discard(alive)
    prefixes = written(_prefixes(whole, percent), "prefixes")
    named = written(components(links(prefixes, whole, percent)), "components")
    discard(whole, prefixes)
    nodes = ids.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    nodes = nodes.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = written(nodes, "nodes")
    # The smallest id of a component stands for it, over all its nodes.
    least = written(nodes.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    named = nodes.join(least, "component").select("node", "component", "component_id")
    return ids.join(named, "node", "left").select("doc_id", "text_hash", "n_shingles", "component", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Every document with ``n_shingles`` and ``component_id``, the smallest id it is linked with."""
    out = classes(docs, words, percent)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near duplicates of others: of each component one row with its smallest id.

    Rows with an empty set are near duplicates of nothing and all stay.
    """
    named = written(classes(docs, words, percent), "classes")
    grouped = named.where("component IS NOT NULL").groupBy("component")
    first = grouped.agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("first.*")
    empty = named.where("component IS NULL").select("doc_id", "text_hash").distinct()
    counts = named.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"))
    chosen = counts.join(first.withColumn("one", F.lit(True)).unionByName(empty.withColumn("one", F.lit(False))).select(
        F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "one"
    ), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    mark, key = "__one_of_many", "__text_hash"
    chosen = chosen.select(
        F.col("id").alias("__doc_id"), F.col("hash").alias(key), (F.col("one") & (F.col("rows") > 1)).alias(mark)
    )
    kept = docs.join(chosen, docs["doc_id"].eqNullSafe(F.col("__doc_id")) & (F.xxhash64(docs["text"]) == F.col(key)))
    # Only rows that are there more than once have to meet.
    several = kept.where(mark).dropDuplicates(["__doc_id", key])
    names = [f"`{n}`" for n in docs.columns]
    return kept.where(f"NOT {mark}").select(*names).unionByName(several.select(*names))
