"""Text counts against a plain count, and the decision list on labelled rows."""

import random
import re
from collections import Counter

from faultline.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    hit = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)), len(hit), sum(c.isupper() for c in "".join(words)), len(set(words)),
    )


def texts():
    rng = random.Random(7)
    made = []
    for size in (2, 4, 12, 40):
        for _ in range(60):
            sep = [" ", " ", "\n", "\t", "  ", "\n\n", "\x0b"]
            made.append("".join(rng.choice(["a", "Bé", "c#", "|", "d", "漢字😀"][:size]) + rng.choice(sep) for _ in range(rng.randint(0, 3 * size))))
    return made + [None, "", " \n ", "a b c d e " * 3000, "one two", "\xa0", "x y z\nx y z\n x y z"]


def test_counts(spark):
    rows = [(k, t, 1) for k, t in enumerate(texts())]
    got = q.statistics(spark.createDataFrame(rows, "doc_id long, text string, n_words long")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {k: plain(t) for k, t, _ in rows}


def test_list_separates_labelled_rows(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for k in range(600):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(20, 60))]
        bad = k % 5 == 0
        if bad:
            words = [w + "#%" for w in words] if k % 10 else [w.upper() for w in words]
        docs.append((k, " ".join(words)))
        labels.append((k, int(not bad)))
    docs += [(1000, "too short"), (1001, None), (1002, "again and again and again " * 20)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame(labels + [(5000, 0), (1, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in q.judge(d, table).collect()}
    assert len(got) == len(docs)
    assert all(got[k].kept == bool(good) for k, good in labels)
    assert [got[k].base_failed for k in (1000, 1001, 1002)] == [True] * 3
    # Both kinds of bad rows have a rule of their own.
    assert len({got[k].rule for k in range(600)}) >= 3


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in q.judge(docs, none).collect()] == [True]
    assert q.judge(docs.limit(0), none).count() == 0
    one_class = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [r.kept for r in q.judge(docs, one_class).collect()] == [True]
