"""Which upstream columns a model's SQL reads, through CTEs, subqueries and ``*``.

The tokens of each model are walked once into facts: every select block offers the columns it names, and those
of the relations behind its ``*``; every column it reads may come from some relations. Relations are
blocks, referenced models and other tables. The rest is joins: what a relation reaches through ``*``, also
through models that declare no columns, and which of the reached relations offers a column.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from faultline.functions import tokens
from faultline.operators.walks import closure
from faultline.session import scratch_dir

# Words that are no columns (fixed values).
KEYWORDS = frozenset(
    """select distinct all from where group by having order limit offset qualify window join inner left right full outer
    cross natural lateral on using as and or not in is null like ilike rlike between exists case when then else end union
    except intersect minus with recursive asc desc nulls first last over partition rows range unbounded preceding
    following current row true false interval any some fetch next only filter within at zone materialized exclude
    replace current_date current_timestamp""".split()
)
# Words that end the list of relations of a block.
_AFTER_FROM = frozenset("where group having order qualify window limit offset fetch".split())
_SET = frozenset("union except intersect minus".split())
_JOINS = frozenset("join inner left right full outer cross natural lateral".split())
_REFERENCE = re.compile(r"\{\{\s*ref\s*\(\s*(?:['\"][^'\"]*['\"]\s*,\s*)?['\"]([^'\"]+)['\"]")
_NAME = re.compile(r"[^\W\d]|[\"`]")

FACTS = "node string, vertex string, is_top boolean, columns array<string>, is_open boolean, targets array<string>, column string"


def _parts(name: str) -> list[str]:
    return [quoted or back or plain for quoted, back, plain in re.findall(r'"([^"]*)"?|`([^`]*)`?|([^."`]+)', name)]


class _Blocks:
    """The select blocks of one model: what each offers and reads."""

    def __init__(self, node: str, signs: list[str]):
        self.node, self.signs, self.blocks = node, signs, []
        self.top, at = self.query(0, None, {}), self.at
        while at < len(signs) and not self.top:
            # Statements before the query, as templates, are passed over.
            self.top, at = self.query(at + 1, None, {}), max(self.at, at + 1)

    def sign(self, i: int) -> str:
        return self.signs[i] if i < len(self.signs) else ""

    def is_name(self, i: int) -> bool:
        return bool(_NAME.match(self.sign(i))) and self.sign(i) not in KEYWORDS

    def query(self, i: int, parent: int | None, ctes: dict) -> list[int]:
        """Blocks of the query at token ``i``, one for each side of a union; ``self.at`` is behind it."""
        ctes, found = dict(ctes), []
        while self.sign(i).startswith("{%"):
            i += 1
        if self.sign(i) == "with":
            i += 1 + (self.sign(i + 1) == "recursive")
            while self.is_name(i):
                name = self.sign(i)
                while i < len(self.signs) and self.sign(i) != "as":
                    i += 1
                while i < len(self.signs) and self.sign(i) != "(":
                    i += 1
                ctes[_parts(name)[-1]] = self.query(i + 1, None, ctes)
                i = self.at + 1
                if self.sign(i) != ",":
                    break
                i += 1
        while True:
            if self.sign(i) == "(":
                found += self.query(i + 1, parent, ctes)
                i = self.at + 1
            elif self.sign(i) == "select":
                found.append(self.select(i + 1, parent, ctes))
                i = self.at
            if self.sign(i) not in _SET:
                break
            i += 1 + (self.sign(i + 1) in ("all", "distinct"))
        self.at = i
        return found

    def relation(self, i: int, ctes: dict, block: dict) -> int:
        """The relation at token ``i`` joins the block; returns the place behind it and its alias."""
        sign = self.sign(i)
        if sign == "(" and self.sign(i + 1) in ("select", "with", "("):
            targets = [self.vertex(b) for b in self.query(i + 1, block["parent"], ctes)]
            names, i = [], self.at + 1
        elif sign.startswith("{{"):
            model = _REFERENCE.match(sign)
            targets = [f"ref:{model[1].lower()}" if model else "?"]
            names, i = [model[1].lower()] if model else [], i + 1
        else:
            names = _parts(sign)[-1:]
            known = len(_parts(sign)) == 1 and names[0] in ctes
            targets = [self.vertex(b) for b in ctes[names[0]]] if known else ["?"]
            i += 1
            if self.sign(i) == "(":
                # A function that gives rows.
                depth = 1
                while depth and i + 1 < len(self.signs):
                    i += 1
                    depth += (self.sign(i) == "(") - (self.sign(i) == ")")
                i += 1
        i += self.sign(i) == "as"
        if self.is_name(i):
            names, i = _parts(self.sign(i))[-1:], i + 1
        for alias in names or [""]:
            block["relations"].append((alias, targets))
        return i

    def vertex(self, block: int) -> str:
        return f"{self.node}#{block}"

    def select(self, i: int, parent: int | None, ctes: dict) -> int:
        """The block behind a ``select``."""
        number = len(self.blocks)
        block = {"parent": parent, "relations": [], "offers": [], "aliases": set(), "stars": [], "reads": [], "open": False}
        self.blocks.append(block)
        depth, clause, item = 0, "select", []
        while i < len(self.signs):
            sign = self.sign(i)
            if depth == 0 and (sign in (")", ";") or sign in _SET and not (sign == "except" and self.sign(i - 1) == "*")):
                break
            if depth == 0 and clause == "select" and sign in (",", "from"):
                self.item(block, item)
                item = []
            elif clause == "select":
                item.append((depth, sign))
            if depth == 0 and clause != "select" and sign in _AFTER_FROM:
                clause = sign
            if depth == 0 and (sign == "from" and clause == "select" or clause == "from" and (sign == "," or sign in _JOINS)):
                clause = "from"
                while self.sign(i + 1) in _JOINS:
                    i += 1
                i = self.relation(i + 1, ctes, block)
                continue
            if sign == "(" and self.sign(i + 1) in ("select", "with"):
                self.query(i + 1, number, ctes)
                i = self.at + 1
                item.append((1, ")"))
                continue
            depth += (sign == "(") - (sign == ")")
            if sign.startswith("{{") and clause == "select":
                block["open"] = True
            if self.is_column(i, depth):
                # A name given further up in the list may be used below; so may all, behind the list.
                given = block["aliases"] if clause == "select" else block["offers"]
                block["reads"].append((_parts(sign), sign in given))
            i += 1
        if clause == "select":
            self.item(block, item)
        self.at = i
        return number

    def is_column(self, i: int, depth: int) -> bool:
        before, after = self.sign(i - 1), self.sign(i + 1)
        if not self.is_name(i) or after[:1] in ("(", "'") or before in ("as", "over") or after == "." and self.sign(i + 2) == "*":
            return False
        # A type behind a cast, a part of a date, a glued template, the alias of an expression.
        if before == ":" or depth and after == "from" or after.startswith("{{"):
            return False
        return not (before[:1] in (")", "'", '"', "`") or before[:1].isalnum() and before not in KEYWORDS or before in ("end", "null", "true", "false"))

    def item(self, block: dict, item: list) -> None:
        """What one entry of the select list offers."""
        flat = [s for d, s in item if s not in ("distinct", "all") or d]
        if not flat:
            return
        if flat[0] == "*":
            block["stars"].append(None)
        elif len(flat) > 2 and flat[1:3] == [".", "*"]:
            block["stars"].append(_parts(flat[0])[-1])
        elif _NAME.match(flat[-1]) and flat[-1] not in KEYWORDS and item[-1][0] == 0:
            block["offers"].append(_parts(flat[-1])[-1])
            if len(flat) > 1:
                block["aliases"].add(_parts(flat[-1])[-1])

    def chain(self, number: int | None) -> list[int]:
        found = []
        while number is not None:
            found.append(number)
            number = self.blocks[number]["parent"]
        return found

    def facts(self):
        """Rows of ``FACTS``: one per block, and one per column that a block reads."""
        for number, block in enumerate(self.blocks):
            own = {}
            for alias, targets in block["relations"]:
                own.setdefault(alias, targets)
            stars = [t for star in block["stars"] for t in (own.get(star, ["?"]) if star else [t for ts in own.values() for t in ts])]
            yield self.node, self.vertex(number), number in self.top, block["offers"], block["open"], stars, None
            names = set()
            for parts, given in block["reads"]:
                if len(parts) > 1:
                    holder = next((b for b in self.chain(number) if any(a == parts[-2] for a, _ in self.blocks[b]["relations"])), None)
                    targets = [] if holder is None else next(t for a, t in self.blocks[holder]["relations"] if a == parts[-2])
                else:
                    targets = [] if given else [t for b in self.chain(number) for _, ts in self.blocks[b]["relations"] for t in ts]
                if targets and (parts[-1], tuple(targets)) not in names:
                    names.add((parts[-1], tuple(targets)))
                    yield self.node, self.vertex(number), False, None, False, targets, parts[-1]


def block_facts(nodes: DataFrame) -> DataFrame:
    """``FACTS`` of every model: rows with a null ``column`` say what a block offers, others what it reads."""

    def run(batches):
        for batch in batches:
            rows = [f for node, signs in zip(batch["node"], batch["signs"]) for f in _Blocks(node, list(signs)).facts()]
            yield pd.DataFrame(rows, columns=["node", "vertex", "is_top", "columns", "is_open", "targets", "column"])

    plain = F.filter(F.transform(tokens.pieces(F.lower("raw_code")), tokens.token), lambda s: s != "")
    cut = nodes.where("raw_code IS NOT NULL").select(F.lower("name").alias("node"), plain.alias("signs"))
    return cut.mapInPandas(run, FACTS)


def column_references(nodes: DataFrame) -> DataFrame:
    """(``node``, ``upstream``, ``column``, ``is_declared``) for every column that a model reads from a model declaring columns.

    ``nodes`` has ``name``, ``raw_code`` and ``columns`` (array of names, null or empty if not declared). Case, comments and
    layout do not matter; names come in lower case. A qualified column belongs to its relation, an unqualified one
    to the relation that offers it, or, if none does, to the only model it could come from. Columns
    that some relation with unknown columns could hold are left out unless a model declares them.
    """
    spark = nodes.sparkSession
    root = scratch_dir(spark, "columns")
    facts = block_facts(nodes)
    facts.write.parquet(root)
    facts = spark.read.schema(FACTS).parquet(root)
    blocks = facts.where("column IS NULL")
    models = nodes.select(
        F.lower("name").alias("model"), F.transform(F.coalesce("columns", F.array()), F.lower).alias("columns")
    ).groupBy("model").agg(F.first("columns").alias("columns"))
    bare = models.where("size(columns) = 0").select("model")
    # What each relation offers; a model without declared columns offers what its last query does.
    offers = blocks.select("vertex", "columns", F.col("is_open"), F.lit(None).cast("string").alias("model")).unionByName(
        models.select(
            F.concat(F.lit("ref:"), "model").alias("vertex"), "columns", F.lit(False).alias("is_open"),
            F.when(F.size("columns") > 0, F.col("model")).alias("model"),
        )
    )
    tops = blocks.where("is_top").join(bare, blocks["node"] == bare["model"]).select(
        F.concat(F.lit("ref:"), "node").alias("come"), F.col("vertex").alias("go")
    )
    edges = blocks.select(F.col("vertex").alias("come"), F.explode("targets").alias("go")).unionByName(tops).distinct()
    pairs = closure(edges, "come", "go", "string").select("a", "b")
    uses = facts.where("column IS NOT NULL").select("node", "vertex", "column", F.explode("targets").alias("a"), F.hash("targets").alias("which"))
    reached = uses.withColumn("b", F.col("a")).unionByName(uses.join(pairs, "a").select(*uses.columns, "b"))
    own = offers.withColumnRenamed("vertex", "b")
    seen = reached.join(own, "b", "left").groupBy("node", "vertex", "column", "which").agg(
        F.bool_or(F.coalesce(F.array_contains("columns", F.col("column")), F.lit(False))).alias("holds"),
        # A relation nobody describes can hold anything, unless it stands for the blocks behind it.
        F.bool_or(F.coalesce("is_open", F.lit(True))).alias("open"),
        F.collect_set("model").alias("models"),
        F.collect_set(F.when(F.array_contains("columns", F.col("column")), F.col("model"))).alias("holders"),
    )
    declared = seen.where("size(holders) > 0").select("node", F.explode("holders").alias("upstream"), "column", F.lit(True).alias("is_declared"))
    missing = seen.where("NOT holds AND NOT open AND size(models) = 1").select(
        "node", F.col("models")[0].alias("upstream"), "column", F.lit(False).alias("is_declared")
    )
    return declared.unionByName(missing).distinct()
