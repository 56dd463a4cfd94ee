"""Targets against plain resharing, and what a balanced sample must hold."""

import random
import re

import numpy as np

from faultline.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Share by weight, cut at the limit, share the excess among the others."""
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = [s for s in order if s not in capped]
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped.update({s: 3 * sizes[s] for s in over})


def check(spark, rows):
    docs = spark.createDataFrame([(d, s, t, 7) for d, s, t in rows], "doc_id long, source string, text string, size int").repartition(3)
    got = mixing.report(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size) for r in got) == sorted(
        (-1 if d is None else d, len(WORD.findall(t or ""))) for d, _, t in rows)
    sizes, source = {}, {}
    for d, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
        source[d] = s
    want = plain_targets(sizes)
    taken, biggest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) <= 1e-6 * max(1, want[s])
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
        biggest[s] = max(biggest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s]
    assert sorted(map(str, got)) == sorted(map(str, mixing.report(docs).collect()))
    assert mixing.mix(docs).count() == sum(r.copies for r in got)
    return got


def test_targets_and_totals(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_UNITS", 50)
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "a", "a", "a", "b", "c", "é", "Z", "😀", "￿"]), "w " * rng.choice([1, 5, 30, 30, 200])) for k in range(1500)]
    check(spark, rows)


def test_edge_rows(spark):
    rows = [(1, None, "a b c"), (2, "x", None), (3, "x", ""), (4, "y", "one"), (5, "y", "one two " * 9000), (6, "z", " "),
            (None, "y", "no id"), (7, "y", "same"), (7, "y", "same")]
    check(spark, rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.report(docs).count() == 0
    assert mixing.mix(docs).count() == 0


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    sides = np.stack([np.ones(2000), rng.integers(0, 50, 2000)], axis=1).astype(float)
    chance = np.full(2000, 0.37)
    after = mixing.flight(chance, sides, rng)
    assert ((after > 0) & (after < 1)).sum() <= 2
    assert np.allclose(after @ sides, chance @ sides)


def test_sample_has_the_wanted_chances():
    sides = np.stack([np.ones(30), np.arange(30)], axis=1).astype(float)
    runs = np.mean([mixing.flight(np.full(30, 0.3), sides, np.random.default_rng(k)) for k in range(2000)], axis=0)
    assert np.abs(runs - 0.3).max() < 0.05


def test_chances_next_to_whole_numbers_are_decided():
    import time

    for near in (1e-10, 1 - 1e-10, 1e-12, 1 - 1e-12):
        chance = np.full(40, near)
        start = time.time()
        flown = mixing.flight(chance, np.ones((40, 2)), np.random.default_rng(1))
        out = mixing.landing(flown, np.ones(40))
        assert (out == round(near)).all() and time.time() - start < 1
