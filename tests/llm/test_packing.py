"""Packing against the tokenizer itself, and the cuts against a search over all of them."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from custodia.llm import packing
from custodia.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def verify(rows, texts, reference):
    """Each id in exactly one piece, sequences gapless from 0 and at most a window; returns padding and tokens."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for key, found in pieces.items():
        ids = np.array([*reference.encode(texts[key] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding, total


def test_query(spark, sf_dir, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    padding, total = verify(QUERIES["op3_packing"](spark, sf_dir).collect(), texts, reference)
    assert padding < 0.01 * total


def test_odd_texts(spark, reference):
    texts = {1: None, 2: "", 3: " \n", 4: "a<|endoftext|>b <|startoftext|>", 5: "x\x1cy z\x1f", 6: "İstanbul ΣΑΣ É é don't I'll", 7: "w" * 9000,
             8: "stop. " * 30_000, 9: "no stop here " * 5000, 10: "  a　b\u0085c", 11: "1234 56.78!? \U0001f600\U0001f600"}
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id int, text string, ids string")
    rows = packing.digest(packing.pack(df.coalesce(1), PATH)).collect()
    padding, total = verify(rows, texts, reference)
    assert padding < 0.01 * total
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "c")], "doc_id long, text string").coalesce(1)
    rows = packing.pack(df, PATH).collect()
    # seven ids; sequences of four, two and one need no padding
    assert [(r.doc_id, r.start, r.length, r.offset) for r in rows] == [(None, 0, 3, 0), (1, 0, 1, 3), (1, 1, 1, 0), (1, 0, 1, 1), (1, 1, 1, 0)]
    assert len({r.sequence_id for r in rows}) == 3


def test_cuts_are_best():
    draw = random.Random(5)
    for _ in range(200):
        at = np.cumsum([0] + [draw.randint(1, 9) for _ in range(draw.randint(1, 11))])
        pen = np.array([0] + [draw.choice((0, 4, 12)) for _ in at[1:]])
        best = {0: 0}
        for j in range(1, len(at)):
            best[j] = min(best[i] + 20 - (at[j] - at[i]) + pen[j] for i in range(j) if at[j] - at[i] <= 20)
        found = packing.cuts(at, pen, 20)
        cost = sum(20 - (b - a) + pen[list(at).index(b)] for a, b in zip(found, found[1:], strict=False))
        assert cost == best[len(at) - 1] and found[0] == 0 and found[-1] == at[-1]


def test_spans_join_up():
    rng = np.random.default_rng(1)
    packer, got = packing.Packer(np.array([7]), 0, 64, 500), defaultdict(list)
    docs = [rng.integers(0, 40, rng.integers(1, 400)) for _ in range(60)]
    out = [p for k, d in enumerate(docs) for p in packer.add(k, d)] + list(packer.finish())
    for key, start, ids, total, *_ in out:
        assert total == len(docs[key]) and start == sum(map(len, got[key]))
        got[key].append(ids)
    assert all((np.concatenate(got[k]) == d).all() for k, d in enumerate(docs))
    assert [s for *_, s, _ in out] == sorted(s for *_, s, _ in out)


def test_words_have_the_ids_of_their_text(reference):
    """Marks set apart and case dropped change no id, whatever stands around them."""
    draw = random.Random(11)
    bits = [" ", "  ", "\n", "a", "The", "É", "œ", "Σ", "ΑΣ", "İ", "ß", "日", "1", "42", ".", ",", "..", "-", "'s", "n't", "_", "́", "​", "\x1c", "\x00", "\U0001f600", "|", "\"", "½", "²", "ª", "ⅷ", "\u0958", "\u0130", "x" * 70]
    texts = ["".join(draw.choices(bits, k=draw.randrange(1, 30))) for _ in range(6000)] + ["a.b", "a .b", "3.14,15", ".", "..", "a,.b", "_.", "._", "é.", ".é", "é.", "a.́"]
    words = packing.WordIds(PATH)
    for at in range(0, len(texts), 500):
        some = texts[at:at + 500]
        for text, ids in zip(some, words.encode(some), strict=True):
            assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)
