"""Quality rules learned as a decision list over statistics of texts.

``statistics`` counts, per document, what the rules look at. ``learn`` covers the
labelled bad documents rule by rule: a rule grows by the threshold condition with the
best information gain on two thirds of the sample, is cut back to the prefix that
separates best on the other third, and leaves the list's remaining rows to the next
rule. ``decide`` turns the list into one ordered conditional expression. All of this is
DataFrame work in the JVM; only counts by feature and threshold reach the driver, and
their number depends on neither the corpus nor the sample.

Null texts count as empty: all statistics are 0 and the base rule fails. Repeated rows
give repeated results. Labels that are null, or of documents that are absent, take no
part; with no bad or no good label the list is empty and only the base rule acts.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import SPLIT, written

# Labelled rows that learning uses at most: those with the smallest hashes of doc_id.
SAMPLE_ROWS = 20_000
# Candidate thresholds of a feature are these quantiles of each class.
QUANTILES = 24
MOST_CONDITIONS = 4
# A rule is used if so many of the held-back rows it covers are bad, and covers so many.
LEAST_PRECISION = 0.95
LEAST_COVER = 5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_distinct_words"]
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_per_word": "n_dup_lines / greatest(n_words, 1)",
    "repeated_share": "n_repeat_words / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
}


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def _step(df: DataFrame, keep: list[str], **new: str) -> DataFrame:
    """Compute columns once: a generator keeps later expressions from copying them."""
    fields = ", ".join(f"'{name}', {sql}" for name, sql in new.items())
    return df.selectExpr(*keep, f"inline(array(named_struct({fields})))")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text.

    n_words; word_chars: code points in words; n_symbols: characters of ``#*$%&|<>``;
    n_dup_lines: lines with a word that equal an earlier one; n_repeat_words: words in
    windows of five words found twice or more; n_capitals: upper-case letters;
    n_distinct_words.
    """
    counts = ["word_chars", "n_symbols", "n_capitals", "n_dup_lines"]
    d = _step(docs.selectExpr("doc_id", "coalesce(text, '') AS text"), ["doc_id", "text"],
              lines=r"filter(split(text, '\\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')",
              hashes=f"transform(array_remove(split(text, '{SPLIT}'), ''), w -> xxhash64(w))".replace("\\", "\\\\"))
    d = _step(d, ["doc_id", "hashes", "size(hashes) AS n_words"],
              word_chars=r"length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ''))",
              n_symbols=r"length(regexp_replace(text, '[^#*$%&|<>]+', ''))",
              n_capitals=r"length(regexp_replace(text, '\\P{Lu}+', ''))",
              n_dup_lines="size(lines) - size(array_distinct(lines))")
    d = _step(d, ["doc_id", "n_words", *counts],
              n_distinct_words="size(array_distinct(hashes))",
              windows="""if(n_words < 5, array(), transform(slice(hashes, 1, greatest(n_words - 4, 0)),
                  (h, i) -> xxhash64(h, hashes[i + 1], hashes[i + 2], hashes[i + 3], hashes[i + 4])))""")
    counts = [*counts, "n_distinct_words"]
    # Most texts repeat no window; only the others sort theirs.
    d = _step(d, ["doc_id", "n_words", *counts, "size(windows) AS n"],
              places="""if(size(array_distinct(windows)) = size(windows), null,
                  sort_array(transform(windows, (h, i) -> struct(h, i))))""")
    d = _step(d, ["doc_id", "n_words", *counts],
              twice="""sort_array(transform(filter(places, (s, i) ->
                  (i > 0 and places[greatest(i - 1, 0)].h = s.h)
                  or (i + 1 < n and places[least(i + 1, n - 1)].h = s.h)), s -> s.i))""")
    d = _step(d, ["doc_id", "n_words", *counts],
              n_repeat_words="""coalesce(5 + aggregate(transform(slice(twice, 2, size(twice)),
                  (p, i) -> least(5, p - twice[i])), 0, (a, x) -> a + x), 0)""")
    return d.select("doc_id", *[F.col(c).cast("long") for c in COUNTS])


def with_features(stats: DataFrame) -> DataFrame:
    return stats.selectExpr("*", *[f"CAST({sql} AS double) AS {name}" for name, sql in FEATURES.items()])


def learn(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules that tell documents with ``quality`` 0 from those with 1, in order.

    ``stats`` is read once for the labelled documents; of these the ``sample_rows``
    with the smallest hashes of their id are used.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    rows = with_features(stats.join(chosen, "doc_id")).select(
        (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)) < 2).alias("grow"),
        *FEATURES,
    )
    rows = written(rows, "labelled")
    cuts = _cuts(rows)
    rules: list[Rule] = []
    left = rows
    while True:
        rule = _grow_and_prune(left, cuts)
        if not rule:
            return rules
        rules.append(rule)
        left = left.where(f"NOT ({rule_sql(rule)})")


def _cuts(rows: DataFrame) -> dict[str, list[float]]:
    shares = [k / QUANTILES for k in range(QUANTILES + 1)]
    found = rows.groupBy("bad").agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in FEATURES]).collect()
    return {f: sorted({float(v) for row in found for v in row[f]}) for f in FEATURES}


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple, int]:
    """Rows by feature, number of thresholds below the value, class and part."""
    bins = [
        f"named_struct('f', '{f}', 'b', size(filter(array({', '.join(f'{c!r}D' for c in cuts[f])}), c -> c < {f})))"
        for f in FEATURES
    ]
    got = rows.selectExpr("bad", "grow", f"inline(array({', '.join(bins)}))").groupBy("f", "b", "bad", "grow").count()
    return {(r.f, r.b, r.bad, r.grow): r["count"] for r in got.collect()}


def _grow_and_prune(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    """One rule, or none if no rule is good enough on the held-back rows."""
    if not any(cuts.values()):
        return ()
    conditions: list[Condition] = []
    held: list[tuple[int, int]] = []
    counts = _counts(rows, cuts)
    first = next(iter(FEATURES))
    total = [sum(v for (f, _, bad, grow), v in counts.items() if f == first and bad == want and grow)
             for want in (True, False)]
    while total[0] and total[1] and len(conditions) < MOST_CONDITIONS:
        best = None
        for f in FEATURES:
            for k, cut in enumerate(cuts[f]):
                for above in (True, False):
                    got = [[sum(v for (g, b, bad, grow), v in counts.items()
                                if g == f and bad == want and grow == part and (b > k) == above)
                            for want in (True, False)] for part in (True, False)]
                    p, n = got[0]
                    if not p or [p, n] == total:
                        continue
                    gain = p * (math.log2(p / (p + n)) - math.log2(total[0] / sum(total)))
                    key = (gain, f, above, -cut)
                    if gain > 0 and (best is None or key > best[0]):
                        best = (key, Condition(f, above, cut), got)
        if best is None:
            break
        conditions.append(best[1])
        total, late = best[2]
        held.append(tuple(late))
        if total[1]:
            counts = _counts(rows.where(rule_sql(tuple(conditions))), cuts)
    worth = [((p - n) / (p + n) if p + n else -1.0, -k) for k, (p, n) in enumerate(held)]
    if not worth:
        return ()
    cut = -max(worth)[1]
    p, n = held[cut]
    if p < LEAST_COVER or p < LEAST_PRECISION * (p + n):
        return ()
    # Later conditions on the same side of a feature are the tighter ones.
    return tuple({(c.feature, c.above): c for c in conditions[: cut + 1]}.values())


def rule_sql(rule: Rule) -> str:
    return " AND ".join(c.sql() for c in rule)


def decide(rules: list[Rule]) -> Column:
    """The number of the first rule that a row meets, from 1, or 0."""
    out: Column | None = None
    for k, rule in enumerate(rules, 1):
        meets = F.expr(rule_sql(rule))
        out = F.when(meets, k) if out is None else out.when(meets, k)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its counts, ``base_failed``, the ``rule`` it meets, and ``kept``."""
    stats = written(statistics(docs), "statistics")
    rules = learn(stats, labels)
    return (
        with_features(stats)
        .withColumn("rule", decide(rules))
        .withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
        .select("doc_id", *COUNTS[:5], "base_failed", "kept", *COUNTS[5:], "rule")
    )
