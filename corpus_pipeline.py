"""The corpus pipeline: five stages from crawled documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the documents of the next stage. All but the last return the columns of
documents; the last returns a row per document with its token ids.

Null and empty texts are rejected by the first stage, as they have no language, unless no document at all
is labelled with one. Of languages with the same score the first by name counts. Repeated rows
are near duplicates of each other, so one of them stays. Empty tables pass through. Further columns stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import byte_bpe, language, mixing, ngram_join, secrets
from faultline.llm.shared import discard, written

# A text whose best language scores less than this has no language the model knows, unless
# its score is small because the text is very short or long: measured scores of such texts in
# a known language are from 0.63 of what the size allows.
LEAST_SCORE = 0.1
LEAST_SHARE = 0.5
# Ranks that encode the texts that are left.
RANKS = "byte_bpe_50k.tiktoken"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language: null, without a letter, or far from all.

    The model learns from ``lang`` of the documents given, and ``lang`` stays as it is. Where no text has a ``lang``
    there is nothing to recognise, and all documents stay.
    """
    found, score, share = into = ("__language", "__language_score", "__language_share")
    model = language.train(docs, F.lit(True))
    if model is None:
        return docs
    scored = language.predict(docs, model, into=into)
    near = (F.col(score) >= LEAST_SCORE) | (F.col(share) >= LEAST_SHARE)
    return scored.where((F.col(found) != language.UNKNOWN) & near).drop(*into)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates."""
    return ngram_join.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts by its kind."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources have their share of words."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text: doc_id, lang, source, n_tokens, token_ids."""
    coded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(RANKS))
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]
# No stage but the second can be told in SQL: a model, decoding, sampling and merges are not expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the documents of a folder."""
    docs, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
