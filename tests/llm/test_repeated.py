"""Removal of repeated passages against a plain count of windows."""

import hashlib
import random
import re

import pytest

from faultline.llm import repeated

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (doc, _), w in zip(rows, words, strict=True):
        if doc is not None:
            for k in range(len(w) - 12):
                key = tuple(w[k : k + 13])
                first[key] = min(doc, first.get(key, doc))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        if doc is not None:
            for k in range(len(w) - 12):
                if first[tuple(w[k : k + 13])] < doc:
                    gone |= set(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, anchors int").repartition(4)
    assert sorted(map(tuple, repeated.remove_repeated(docs).collect()), key=str) == plain(rows)


@pytest.mark.parametrize("vocabulary, seed", [(2000, 1), (3, 2), (1, 3)])
def test_matches_plain_windows(spark, vocabulary, seed, monkeypatch):
    monkeypatch.setattr(repeated, "SHARD_SEGMENTS", 40)
    rng = random.Random(seed)
    words = [f"w{k}é" for k in range(vocabulary)]
    passages = [[rng.choice(words) for _ in range(rng.randint(10, 60))] for _ in range(12)]
    rows = []
    for k in range(150):
        text = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            text += [rng.choice(words) for _ in range(rng.randint(0, 15))] + p[a:]
        rows.append((rng.randint(0, 140), rng.choice([" ", "\n", " \t"]).join(text)))
    check(spark, rows)


def test_edge_rows(spark):
    base = " ".join(f"a{k}" for k in range(13))
    long = " ".join(f"x{k}" for k in range(30000))
    rows = [(1, None), (2, ""), (3, base), (4, base + " end"), (4, base + " end"), (4, "other " + base), (5, "one two"), (None, base),
            (None, base), (6, long), (7, long + " " + base), (8, " ".join(["same"] * 40)), (9, " ".join(["same"] * 20)), (-1, base)]
    check(spark, rows)


def test_one_passage_in_all_documents(spark, monkeypatch):
    monkeypatch.setattr(repeated, "SHARD_SEGMENTS", 100)
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(60))
    check(spark, [(k, f"{rng.random()} {rng.random()} {passage} {rng.random()} " + f"tail{k} " * 13) for k in range(300)])


def test_empty_table(spark):
    assert repeated.remove_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_of_any_kind(spark):
    text = " ".join(f"w{k}" for k in range(40))
    for kind, ids in (("string", ["a", "b"]), ("int", [1, 2]), ("decimal(20,0)", [1, 2])):
        rows = spark.createDataFrame([(str(i), text) for i in ids], "doc_id string, text string")
        got = repeated.remove_repeated(rows.selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")).collect()
        assert sorted(r.n_removed for r in got) == [0, 40]
