"""Runs of words, against brute force and in odd rows."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from faultline.llm import runs


def brute(words, repeats=4, least=6):
    """All runs by walking along every period."""
    n, found = len(words), {}
    for q in range(1, n // repeats + 1):
        i, need = 0, max(least, repeats * q) - q
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= need:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def numbered(texts):
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    values = np.concatenate([np.asarray(t, np.int64) for t in texts]) if texts else np.zeros(0, np.int64)
    found = list(zip(*(v.tolist() for v in runs.find(values, first))))
    return [[r[1:] for r in found if r[0] == k] for k in range(len(texts))]


def test_difference_cover():
    for a in range(runs.MODULUS):
        for b in range(runs.MODULUS):
            shift = runs._SHIFTS[a, b]
            assert {(a + shift) % runs.MODULUS, (b + shift) % runs.MODULUS} <= set(runs.COVER)


@pytest.mark.parametrize("seed", range(40))
def test_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(int(rng.integers(1, 7))):
        text = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 120))).tolist()
        if text and rng.random() < 0.5:
            piece = text[: int(rng.integers(1, len(text) + 1))]
            text = text[:20] + piece * int(rng.integers(2, 9)) + text[-5:]
        texts.append(text)
    assert numbered(texts) == [brute(t) for t in texts]


def test_long_periods_and_one_word():
    rng = np.random.default_rng(5)
    piece = rng.integers(0, 50, 333).tolist()
    texts = [[7] * 3000, piece * 5 + [99], rng.integers(0, 2, 2000).tolist(), ([1, 2] * 40 + [3]) * 6]
    assert numbered(texts) == [brute(t) for t in texts]


def test_agreement():
    rng = np.random.default_rng(9)
    values = np.concatenate([np.tile(rng.integers(0, 3, 70), 9), [9]])
    agree = runs.Agreement(values.astype(np.int64))
    a, b = rng.integers(0, len(values), (2, 3000))
    a, b = a[a != b], b[a != b]
    want = []
    for x, y in zip(a, b):
        k = 0
        while max(x, y) + k < len(values) and values[x + k] == values[y + k]:
            k += 1
        want.append(k)
    assert agree(a, b).tolist() == want


def test_points_in_pieces(monkeypatch):
    texts = [[1, 2, 3] * 30, [], [5] * 17, list(range(40))]
    want = numbered(texts)
    monkeypatch.setattr(runs, "POINTS", 3)
    assert numbered(texts) == want == [brute(t) for t in texts]


def planted(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(words):
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    listing = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        len(found), *best, 1000 * best[1] // best[2] if found else None,
        hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


def test_query_on_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    short = [k for k, t in texts.items() if len(t or "") < 20_000]
    got = {r.doc_id: r for r in runs.report(docs).collect()}
    assert got.keys() == texts.keys() and len(short) > 150
    for k in short:
        assert tuple(got[k])[1:] == expected(planted(k, texts[k])), k
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k in short) > 5


def test_odd_rows(spark):
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \t\n", None), (None, "a " * 50, "y"), (5, "a b " * 20 + "c", "y"),
        (5, "a b " * 20 + "c", "y"), (6, "é é é é é é é é é é é é", None), (7, "A a " * 9, "z"),
        (8, "w " * 200_000, "long"), (9, "p q r s t", "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    listed = runs.find_runs(docs).collect()
    by = {(r.doc_id, len(r.text or "")): [tuple(x) for x in r.runs] for r in listed}
    assert len(listed) == len(rows)
    assert by[(1, 0)] == by[(2, 0)] == by[(3, 3)] == by[(9, 9)] == []
    assert by[(None, 100)] == [(0, 50, 1)] and by[(5, 81)] == [(0, 40, 2)] and by[(6, 23)] == [(0, 6, 1)]
    assert by[(7, 36)] == [(0, 18, 2)] and by[(8, 400_000)] == [(0, 200_000, 1)]
    texts = {r.doc_id: r.collapsed for r in runs.collapse(docs).collect()}
    assert texts == {1: "", 2: "", 3: "", None: "a", 5: "a b c", 6: "é é", 7: "A a", 8: "w", 9: "p q r s t"}
    report = {r.doc_id: r for r in runs.report(docs.drop("runs")).collect()}
    assert report[1].n_runs == 0 and report[1].start is None and report[1].exponent_milli is None
    assert report[None].exponent_milli == 50_000


def test_other_limits(spark):
    docs = spark.createDataFrame([(1, "a b a b c c")], "doc_id long, text string")
    assert [tuple(x) for x in runs.find_runs(docs, repeats=2, least=2).first().runs] == [(0, 4, 2), (4, 2, 1)]


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert runs.report(docs).collect() == [] and runs.collapse(docs).collect() == []
