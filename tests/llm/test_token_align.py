"""Cross-tokenizer alignment against whole-text encodings and nested loops over groups."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from custodia.llm import token_align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = token_align.byte_letters()

    def groups(text):
        """[(ids of A, ids of B)] of a text, by the ends that both share."""
        if not text:
            return []
        line = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = []
        for i in ids_b:
            p = b.id_to_piece(i)
            raw_b.append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
        if b"".join(raw_a) != line or b"".join(raw_b) != line:
            return []
        ends_a, ends_b = np.cumsum([*map(len, raw_a)]), np.cumsum([*map(len, raw_b)])
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        out = [([], []) for _ in cuts]
        for i, e in zip(ids_a, ends_a, strict=True):
            out[np.searchsorted(cuts, e)][0].append(i)
        for i, e in zip(ids_b, ends_b, strict=True):
            out[np.searchsorted(cuts, e)][1].append(i)
        return out

    def whole(texts):
        """Expected facts of all texts, in order."""
        cut = [groups(t) for t in texts]
        links = [Counter((x, y) for xs, ys in g for x in xs for y in ys) for g in cut]
        docs = Counter(p for c in links for p in c)
        best = defaultdict(int)
        for (x, _), n in docs.items():
            best[x] = max(best[x], n)
        out = []
        for g, c in zip(cut, links, strict=True):
            line = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
            out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()),
                        sum(n for p, n in c.items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in c.items()),
                        hashlib.sha256(line.encode()).hexdigest() if g else ""))
        return out, docs, best
    return whole


ODD = [None, "", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a \n b\tc", "\n\nx", "x\n", "x\n\n", "tab\there", "nb sp ace", "a\x1cb c", "a\x00b c",
       "<|endoftext|> </s> <s> <unk> <0x41>", "U+2581 ▁ here", "▁", "émigré naïve Ünïcode", "日本語のテキスト。 次の文", "\U0001f600\U0001f600 smile \U0001f468‍\U0001f469",
       "don't we'll I'm", "1234567 3.14 0x1F", "....   ....", "word " * 50, "supercalifragilistic" * 30, "aaaa" * 500, "́combining é", "　wide　space", "end.\nNext line\n- item",
       "a b c \u0085d", "  two  spaces  ", "mixed\r\nline\r\nends", "zero​width﻿", "q\u0000", "ſtrange K", "same words same words"]


def test_odd_texts(spark, plain):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, "same words same words", "y"), (None, "a", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, links string")
    out, pairs = token_align.align(df, A, B)
    want, docs, best = plain([t for _, t, _ in rows])
    expected = sorted(((i, *w) for (i, _, _), w in zip(rows, want, strict=True)), key=str)
    assert sorted((tuple([r.doc_id, *(r[f] for f in FIELDS)]) for r in out.collect()), key=str) == expected
    assert {((r.a, r.b), r.docs, r.best) for r in pairs.collect()} == {(p, n, n == best[p[0]]) for p, n in docs.items()}
    zeros = {r.doc_id for r in out.collect() if r.n_a == 0}
    assert {0, 1, ODD.index("▁"), ODD.index("U+2581 ▁ here")} <= zeros


def test_whole_table_in_small_blocks(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain([t for _, t in rows])[0]
    for block in (2_000, token_align.BLOCK):
        out, _ = token_align.align(docs, A, B, block)
        assert sorted(tuple([r.doc_id, *(r[f] for f in FIELDS)]) for r in out.collect()) == sorted((i, *w) for (i, _), w in zip(rows, want, strict=True))


def test_random_texts_align_like_whole_ones(plain):
    """Segments stand alone: any mix of white space, marks and letters, with the memory cleared on the way."""
    draw = random.Random(3)
    bits = [" ", "  ", "\n", "\n\n", "\t", " ", "\x1d", "a", "the", "don't", "É", "日", "1", "99", ".", ",", "-", "'s", "\U0001f600", "ing", "Z"]
    texts = ["".join(draw.choices(bits, k=draw.randrange(1, 40))) for _ in range(3000)]
    own = token_align.Aligner(A, B)
    got = []
    for at in range(0, len(texts), 500):
        got += own.align(texts[at:at + 500])
        if at == 1000:
            own.clear()
    for text, g, w in zip(texts, got, plain(texts)[0], strict=True):
        assert (*g[:4], g[4]) == (*w[:4], w[6]), repr(text)
        assert int(g[6].sum()) == w[3]


def test_products():
    draw = np.random.default_rng(1)
    x, y = draw.integers(0, 3, (30, 40)) * (draw.random((30, 40)) < 0.2), draw.integers(0, 3, (40, 20)) * (draw.random((40, 20)) < 0.2)
    sparse = lambda m: token_align.CSR.of(*np.nonzero(m), m[np.nonzero(m)], m.shape)

    def dense(m):
        out = np.zeros((len(m.start) - 1, m.width), int)
        out[m.rows(), m.at] = m.value
        return out
    assert (dense(sparse(x).times(sparse(y))) == x @ y).all() and (dense(sparse(x).transpose()) == x.T).all()


def test_huge_groups_in_parts(monkeypatch, plain):
    """Products that are expanded in parts add up."""
    texts = ["日本語のテキスト" * 40, "x" * 3000, "a b c", "\U0001f468‍\U0001f469‍\U0001f467" * 50]
    monkeypatch.setattr(token_align, "PART", 7)
    for g, w in zip(token_align.Aligner(A, B).align(texts), plain(texts)[0], strict=True):
        assert (*g[:4], g[4]) == (*w[:4], w[6]) and int(g[6].sum()) == w[3] and (np.diff(g[5]) > 0).all()


def test_empty_table(spark):
    out, pairs = token_align.align(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert out.count() == 0 and pairs.count() == 0 and set(out.columns) == {"doc_id", *FIELDS}
