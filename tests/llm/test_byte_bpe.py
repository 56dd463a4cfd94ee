"""Byte-level BPE against the library that defines the ids, and exact round trips."""

import base64
import hashlib
import random

import public_tokenizers
import tiktoken

from faultline.llm import byte_bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["'", "s", "r", "e", "ll", " ", "  ", "\n", "\t", "a", "é", "1", "٣", "!", "-", "'re", "'ve",
         "　", "\x85", "\x1c", "漢", "😀", "'d", "x'", " ", "Zs", "<|endoftext|>"]


def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(600)]
    return made + [None, "", " ", "a" * 5000, "é=" * 400, " " * 700, "\n\n x", made[0], "it's we'll 'tis ''s"]


def test_ids_and_decoded_bytes(spark):
    rows = [(k, t, -k) for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids long").repartition(3)
    got = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS).collect()
    lib = library()
    assert len(got) == len(rows)
    for row in got:
        text = row.text or ""
        raw = text.encode()
        assert list(row.token_ids) == lib.encode_ordinary(text)
        assert bytes(row.decoded) == raw
        assert not row.token_ids or row.token_ends[-1] == len(raw)
        start = 0
        for token, end in zip(row.token_ids, row.token_ends, strict=True):
            assert raw[start:end] == lib.decode_single_token_bytes(token)
            start = end


def test_digests(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    lib = library()
    want = {
        (k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
         hashlib.sha256((t or "").encode()).hexdigest())
        for k, t in enumerate(texts()) for ids in [lib.encode_ordinary(t or "")]
    }
    assert {tuple(r) for r in byte_bpe.digests(docs, RANKS).collect()} == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.digests(docs, RANKS).count() == 0
    assert byte_bpe.encode(docs, RANKS).count() == 0
