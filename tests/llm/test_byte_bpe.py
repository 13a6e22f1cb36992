"""Byte-level BPE against the tiktoken library, and a round trip."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from custodia.llm import byte_bpe
from custodia.llm.queries import QUERIES

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    slots = sorted(byte_bpe.PerfectHash(keys).slot(k) for k in keys)
    assert slots == list(range(5000))


def test_pieces(reference):
    own, draw = byte_bpe.coder(PATH, P.PATTERN), random.Random(2)
    texts = ["", " ", "a", "don't  stop\n\n now ", "<|endoftext|>", "\x1c\x1d a\x1fb\x85\xa0c　d", "é" * 300, "ab" * 4000, "a\u0558b \u088f1 x\U00011de0y \u0558 ok", "\U0001f600 naïve Ünïcode ١٢٣ ½",
             " " * 500 + "x", "áb ​﻿"]
    texts += ["".join(draw.choice("abc ABC.,'\n\té漢1 2s") for _ in range(draw.randint(1, 60))) for _ in range(1500)]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == reference.encode_ordinary(t), repr(t[:60])
        assert own.decode(own.encode(t)) == t.encode()


def test_query(spark, sf_dir, reference):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op9_byte_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x", None), (None, "", None, 2), (3, "a b", "y", 3), (3, "a b", "y", 3)], "doc_id int, text string, ids string, `a.b` int")
    out = byte_bpe.decode(byte_bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN)
    assert out.columns == ["doc_id", "text", "a.b", "ids", "decoded"]
    assert sorted(bytes(r.decoded).decode() for r in out.collect()) == ["", "", "a b", "a b"]
    assert byte_bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0
