"""Near duplicates against all pairs."""

import random
import re

import pytest

from faultline.llm import ngram_join
from faultline.llm.components import components
from faultline.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def plain(rows):
    """(doc_id, n_shingles, component_id) from all pairs."""
    found = [shingles(t) for _, t in rows]
    name = list(range(len(rows)))

    def root(k):
        while name[k] != k:
            k = name[k]
        return k

    where = {}
    for k, s in enumerate(found):
        for other in {j for token in s for j in where.get(token, ())}:
            common = len(s & found[other])
            if 100 * common >= 80 * (len(s) + len(found[other]) - common):
                name[root(k)] = root(other)
        for token in s:
            where.setdefault(token, []).append(k)
    ids = {}
    for k, (doc, _) in enumerate(rows):
        ids[root(k)] = min([doc, *ids.get(root(k), [])] if root(k) not in ids else [doc, ids[root(k)]])
    return sorted((doc, len(found[k]), ids[root(k)] if found[k] else doc) for k, (doc, _) in enumerate(rows))


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, node int").repartition(4)
    assert sorted(map(tuple, ngram_join.near_duplicates(docs).collect())) == plain(rows)


def made(seed, n, vocabulary, edits):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    bases = [[rng.choice(words) for _ in range(rng.randint(1, 80))] for _ in range(n // 6)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = []
    for k in range(n):
        text = list(rng.choice(bases))
        if rng.random() < 0.3:
            text += passage
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((k, rng.choice([" ", "\n", "\t "]).join(text).replace("w1", rng.choice(["w1", "W1"]))))
    return rows


@pytest.mark.parametrize("seed, n, vocabulary, edits", [(1, 300, 5000, 3), (2, 300, 6, 6), (3, 200, 60, 1)])
def test_matches_all_pairs(spark, seed, n, vocabulary, edits):
    check(spark, made(seed, n, vocabulary, edits))


def test_edge_rows(spark):
    long = " ".join(f"x{k}" for k in range(30000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One TWO"), (6, "two one"), (7, "one"), (8, long),
            (9, long + " end"), (9, long + " end"), (10, "é É"), (11, "é é"), (12, None), (13, "a b c d e"), (14, "a b c d e")]
    check(spark, rows)


def test_one_group_of_copies_and_near_copies(spark):
    rng = random.Random(9)
    base = [f"v{k}" for k in range(120)]
    rows = [(k, " ".join(base)) for k in range(400)]
    for k in range(400, 800):
        text = list(base)
        for _ in range(rng.randint(1, 3)):
            text[rng.randrange(120)] = f"u{rng.randrange(10**6)}"
        rows.append((k, " ".join(text)))
    check(spark, rows)


def test_given_documents(spark):
    root = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op1_ngram_join"](spark, root).collect())) == plain(rows)


def test_empty_table(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 200), (300, 200), (7, 7)] + [(1000, 1000 + k) for k in range(1, 30)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 200: 100, 300: 100, **{k: 1000 for k in range(1000, 1030)}}
