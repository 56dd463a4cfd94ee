"""Language of texts by a string kernel.

The kernel of two texts is a blend of spectra: for n-grams of one to three letters, the
weighted number of grams present in both, divided by the norms of both. Grams are
hashed to a fixed number of places. Nystroem landmarks, equally many training texts of
each language, span the feature space, and one ridge regression per language
against the rest is solved in it. Scoring a block of texts is a product of its
presence matrix with the landmarks and of that with the regression weights.

Every language among the labels is learned, however many there are, from a bounded sample of its texts. The landmarks
are chosen first; the products of features that the regressions need are summed by the tasks that hold the
sample, so only the landmarks and matrices of their size, with one column per language, reach the driver. Texts that are
null or have no letter are ``und`` with score 0, as is every text if nothing could be learned. Of languages
with the same score the first by name is taken. Equal texts get equal results.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from faultline.llm.characters import code_points, folded
from faultline.llm.shared import Block, blocks, discard, mix, written

# Places and kernel weight of grams by their length.
PLACES = {1: 512, 2: 2048, 3: 4096}
WEIGHTS = {1: 0.5, 2: 1.0, 3: 2.0}
# Training texts of one language, landmarks shared by the languages, and the most landmarks there are: beyond 128 languages
# each gives one, and beyond 512 the landmarks are a sample of the languages.
ROWS_PER_LANGUAGE = 1000
LANDMARKS = 128
MOST_LANDMARKS = 512
# Texts whose dense rows are held at once, and tasks that add up sums.
BLOCK_ROWS = 512
ADDING_TASKS = 8
RIDGE = 1e-2
UNKNOWN = "und"

_SIZE = sum(PLACES.values())
_SCALE = np.repeat([WEIGHTS[n] ** 0.5 for n in PLACES], list(PLACES.values())).astype(np.float32)


class Model(NamedTuple):
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    # Norm of a usual landmark before it is scaled.
    norm: float = 1.0


def presence(block: Block) -> np.ndarray:
    """One row per text with 1 at the place of each gram in it."""
    points, _, first = code_points(block.data, block.offsets)
    letters = folded()[points].astype(np.uint64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.zeros((len(first) - 1, _SIZE), np.float32)
    flat, base = out.reshape(-1), 0
    rows = owner * _SIZE
    gram = np.zeros(len(letters), np.uint64)
    for n, places in PLACES.items():
        # Each gram extends the one that is shorter by a letter.
        size = len(letters) - n + 1
        if size <= 0:
            break
        gram = gram[:size] << np.uint64(21) | letters[n - 1 :]
        place = (mix(gram) & np.uint64(places - 1)).astype(np.int64) + base
        real = (owner[:size] == owner[n - 1 :]) & (letters[:size] != 32)
        flat[(rows[:size] + place)[real]] = 1
        base += places
    return out


def _normal(bits: np.ndarray) -> np.ndarray:
    """Rows scaled so that products of rows are kernel values; rows without grams stay 0."""
    rows = bits * _SCALE
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def _sample(docs: DataFrame, usable: Column, rows_per_language: int) -> DataFrame:
    """Language, place and presence bits of the training texts, written. At most ``rows_per_language`` of each language."""
    known = docs.select("doc_id", "lang").where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = known.groupBy("lang").count()
    # The smallest hashes are wanted: a share of them, a few times the number wanted, is
    # cut out before rows of a language meet for their rank.
    share = F.least(F.lit(1.0), F.lit(4.0 * rows_per_language) / F.col("count"))
    place = F.xxhash64("doc_id")
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    chosen = (
        known.join(counts, "lang")
        .where(place.cast("double") / 2.0**63 <= 2 * share - 1)
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= rows_per_language)
        .select("doc_id", "lang").distinct()
    )
    # As a table its size is known, so Spark broadcasts it where it is small, and shuffles no texts.
    chosen = written(chosen, "language-chosen")
    texts = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang", "text")

    def run(batches):
        for block in blocks(batches, rows=BLOCK_ROWS):
            bits = np.packbits(presence(block) > 0, axis=1)
            yield pa.RecordBatch.from_arrays(
                [block.rows.column("lang"), pa.array([b.tobytes() for b in bits], pa.binary())], names=["lang", "bits"]
            )

    found = texts.join(chosen, ["doc_id", "lang"], "left_semi").mapInArrow(run, "lang string, bits binary")
    # Repeated ids could add rows, so the bound is set again.
    order = Window.partitionBy("lang").orderBy(F.xxhash64("bits"), "bits")
    ranked = found.withColumn("place", F.row_number().over(order))
    sample = written(ranked.where(F.col("place") <= rows_per_language), "language-sample")
    discard(chosen)
    return sample


def _bits(rows) -> np.ndarray:
    """Presence rows from packed bits."""
    packed = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    return np.unpackbits(packed, axis=1)[:, :_SIZE]


def _sums(sample: DataFrame, landmarks: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Features'features of the sample, and the sum of the features of each language."""
    spark = sample.sparkSession
    shared = spark.sparkContext.broadcast((landmarks, root))

    def run(batches):
        points, axes = shared.value
        gram, by_language = np.zeros((axes.shape[1], axes.shape[1])), {}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                features = (_normal(_bits(part.column("bits").to_pylist())) @ points.T).astype(np.float64) @ axes
                gram += features.T @ features
                names = np.array(part.column("lang").to_pylist(), object)
                for name in set(names):
                    by_language[name] = by_language.get(name, 0) + features[names == name].sum(axis=0)
        yield pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([None, *by_language], pa.string()),
                "values": pa.array([gram.tobytes(), *[v.tobytes() for v in by_language.values()]], pa.binary()),
            }
        )

    def add(batches):
        totals: dict = {}
        for batch in batches:
            for name, values in zip(batch.column("lang").to_pylist(), batch.column("values").to_pylist()):
                totals[name] = totals.get(name, 0) + np.frombuffer(values)
        yield pa.RecordBatch.from_pydict(
            {
                "lang": pa.array(list(totals), pa.string()),
                "values": pa.array([v.tobytes() for v in totals.values()], pa.binary()),
            }
        )

    schema = "lang string, values binary"
    partial = sample.select("lang", "bits").mapInArrow(run, schema)
    # Sums of languages meet by name; the larger matrix is dealt over the tasks.
    dealt = partial.repartition(ADDING_TASKS, F.coalesce("lang", F.spark_partition_id().cast("string"))).mapInArrow(add, schema)
    gram, by_language = 0, {}
    for row in dealt.collect():
        values = np.frombuffer(bytes(row.values))
        if row.lang is None:
            gram = gram + values
        else:
            by_language[row.lang] = by_language.get(row.lang, 0) + values
    return gram.reshape(root.shape[1], root.shape[1]), by_language


def train(docs: DataFrame, usable: Column, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """A model of all languages in ``lang``, from texts where ``usable`` holds; none without a labelled text."""
    sample = _sample(docs, usable, rows_per_language)
    try:
        counts = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
        languages = sorted(counts)
        if not languages:
            return None
        each = max(1, LANDMARKS // len(languages))
        first = sample.where(F.col("place") <= each).orderBy(F.xxhash64("bits", "lang"), "lang", "place")
        present = _bits([bytes(r.bits) for r in first.limit(max(MOST_LANDMARKS, LANDMARKS)).collect()])
        landmarks = np.unique(_normal(present), axis=0)
        norm = float(np.median(np.linalg.norm(present * _SCALE, axis=1)))
        values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
        good = values > 1e-6 * max(values[-1], 1e-12)
        root = vectors[:, good] / np.sqrt(values[good])
        gram, by_language = _sums(sample, landmarks, root)
        total = sum(counts.values())
        gram = gram + RIDGE * total * np.eye(len(gram)) / len(gram)
        wanted = np.stack([by_language[name] for name in languages], axis=1)
        return Model(languages, landmarks, (root @ np.linalg.solve(gram, wanted)).astype(np.float32), norm)
    finally:
        discard(sample)


def scores(model: Model, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Scores of each text by language, and whether the text has a letter."""
    by_language, real, _ = _scored(model, block)
    return by_language, real


def _scored(model: Model, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Also the kernel value that a text reaches at most with a usual landmark, by the norms of both."""
    bits = presence(block)
    norms = np.linalg.norm(bits * _SCALE, axis=1)
    most = np.minimum(norms, model.norm) / np.maximum(np.maximum(norms, model.norm), 1e-12)
    return (_normal(bits) @ model.landmarks.T) @ model.weights, bits.any(axis=1), np.maximum(most, 1e-12)


def predict(
    docs: DataFrame, model: Model | None, text: str = "text", into: tuple[str, ...] = ("lang_pred", "score")
) -> DataFrame:
    """Every row with its language and a score from 0 to 1, in the columns ``into``, which they replace.

    Kernel values of texts with far fewer or far more grams than the landmarks are small
    whatever the language. A third column has the score as a share of what the size of the text allows.
    """
    kept = [f for f in docs.schema if f.name not in into]
    if model is None:
        plain = docs.select(*[f"`{f.name}`" for f in kept])
        return plain.withColumns({into[0]: F.lit(UNKNOWN), **{n: F.lit(0.0) for n in into[1:]}})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in kept]

    def run(batches):
        known = shared.value
        label = np.array([*known.languages, UNKNOWN], object)
        for block in blocks(batches, text, rows=BLOCK_ROWS):
            by_language, real, most = _scored(known, block)
            best = np.where(real, by_language.argmax(axis=1), len(known.languages))
            score = by_language.max(axis=1)
            values = [np.where(real, np.clip(v, 0, 1), 0.0) for v in (score, score / most)[: len(into) - 1]]
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(block.rows.schema.get_field_index(n)) for n in names]
                + [pa.array(label[best], pa.string()), *[pa.array(v, pa.float64()) for v in values]],
                names=[*names, *into],
            )

    more = [T.StructField(into[0], T.StringType()), *[T.StructField(n, T.DoubleType()) for n in into[1:]]]
    return docs.mapInArrow(run, T.StructType([*kept, *more]))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from documents outside the held-out third and predict all: doc_id, held_out, lang_pred, score."""
    model = train(docs, remainder() != 1)
    rows = docs.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "text")
    return predict(rows, model).drop("text")
