"""Held-out accuracy, and rows that have no language."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from faultline.llm import language
from faultline.llm.queries import QUERIES

ROOT = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = QUERIES["op10_language_id"](spark, ROOT).collect()
    truth = {r.doc_id: r for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    right = sum(r.lang_pred == truth[r.doc_id].lang for r in held)
    assert right / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def rows(spark):
    made = [(k, "the cat and the dog " * (1 + k % 3), "en", 1.0) for k in range(20)]
    made += [(100 + k, "der Hund und die Katze " * (1 + k % 3), "de", 1.0) for k in range(20)]
    made += [(200, None, "en", 1.0), (201, "", None, 1.0), (202, "123 !? 4", "de", 1.0), (203, "Der Hund " * 20000, None, 1.0),
             (None, "the dog", "en", 1.0), (0, "the cat and the dog ", "en", 1.0)]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, score double")


def test_edge_rows(spark):
    got = language.identify(rows(spark)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 46
    assert [by[k].lang_pred for k in (200, 201, 202)] == ["und"] * 3
    assert [by[k].score for k in (200, 201, 202)] == [0.0] * 3
    assert by[203].lang_pred == "de"
    assert by[None].lang_pred == "en" and by[None].held_out is False
    assert all(by[k].lang_pred == "en" for k in range(20))


def test_nothing_to_learn_from(spark):
    docs = rows(spark)
    assert language.identify(docs.limit(0)).count() == 0
    unknown = docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert {r.lang_pred for r in language.identify(unknown).collect()} == {"und"}


def invented(languages, texts, seed):
    """Texts of languages that each have their own words."""
    rng = random.Random(seed)
    made = []
    for k in range(languages):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 7))) for _ in range(25)]
        made += [(len(made) + n, " ".join(rng.choices(words, k=40)), f"l{k:03d}") for n in range(texts)]
    return made


def test_no_language_is_left_out(spark):
    made = invented(300, 6, 4)
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = language.train(docs, F.col("doc_id") % 3 != 1)
    assert len(model.languages) == 300
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    held = [(k, lang) for k, _, lang in made if k % 3 == 1]
    assert sum(got[k] == lang for k, lang in held) >= 0.97 * len(held)
    assert set(got.values()) >= {lang for _, lang in held}


def test_model_against_a_dense_computation(spark):
    made = invented(5, 30, 8)
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = language.train(docs, F.lit(True))
    batch = pa.RecordBatch.from_pydict({"text": [t for _, t, _ in made]})
    [block] = language.blocks([batch])

    def grams(text):
        """Places of the grams of a text, by plain code."""
        found = set()
        for n, base in ((1, 0), (2, 512), (3, 2560)):
            for i in range(len(text) - n + 1):
                # Grams begin with a letter.
                if text[i] != " ":
                    value = 0
                    for c in text[i : i + n]:
                        value = value << 21 | ord(c)
                    value = int(language.mix(np.array([value & (1 << 64) - 1], np.uint64))[0])
                    found.add(base + value % language.PLACES[n])
        return found

    x = np.zeros((len(made), language._SIZE))
    for row, (_, text, _) in enumerate(made):
        for place in grams(text):
            x[row, place] = language._SCALE[place]
    assert ((x > 0) == (language.presence(block) > 0)).all()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([[float(lang == name) for name in model.languages] for _, _, lang in made])
    values, vectors = np.linalg.eigh(model.landmarks.astype(float) @ model.landmarks.astype(float).T)
    good = values > 1e-6 * values[-1]
    features = x @ model.landmarks.T @ (vectors[:, good] / np.sqrt(values[good]))
    ridge = language.RIDGE * len(x) / features.shape[1]
    want = features @ np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ y)
    assert np.abs(language.scores(model, block)[0] - want).max() < 1e-3


def test_ties_go_to_the_first_name(spark):
    docs = spark.createDataFrame([(k, "same words here", lang) for k, lang in enumerate(["b", "a", "c"])], "doc_id long, text string, lang string")
    model = language.train(docs, F.lit(True))
    assert {r.lang_pred for r in language.predict(docs, model).collect()} == {"a"}


def test_many_short_texts_in_bounded_memory(spark):
    docs = spark.createDataFrame(invented(4, 10, 2), "doc_id long, text string, lang string")
    model = language.train(docs, F.lit(True))
    batch = pa.RecordBatch.from_pydict({"text": [f"short text no {k}" for k in range(10_000)]})
    tracemalloc.start()
    for block in language.blocks([batch], rows=language.BLOCK_ROWS):
        assert len(language.scores(model, block)[0]) <= language.BLOCK_ROWS
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
