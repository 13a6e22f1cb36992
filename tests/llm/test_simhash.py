"""SimHash groups against brute force."""

import random
import re

import xxhash

from custodia.llm import simhash
from custodia.llm.queries import QUERIES

from .conftest import components


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint():
    for t in (None, "", " \t", "One", "one TWO", "a b c", "É b\x0bc d e f", "x " * 5000, "\x1c \x85 a\x1cb c d e"):
        assert simhash.simhash(t or "") == plain(t)


def test_anchors_lose_no_link(spark):
    draw = random.Random(3)
    prints = [draw.getrandbits(64) for _ in range(300)] + [0, 2**64 - 1, 2**63, 1]
    for p in list(prints):
        for k in (1, 2, 3, 4):
            for b in draw.sample(range(64), k):
                p ^= 1 << b
            prints.append(p)
    for b in range(64):  # a dense ball
        prints.append(prints[0] ^ (1 << b))
    prints = sorted({p - 2**64 if p >= 2**63 else p for p in prints})
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    want = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1:] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert got == want and len(want) > 900


def brute(rows):
    prints = {i: plain(t) for i, t in rows}
    ids = sorted(prints)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if bin(prints[a] ^ prints[b]).count("1") <= 3]
    return {i: (f"{prints[i]:016x}", c) for i, c in components(ids, pairs).items()}


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash"](spark, sf_dir).collect()}
    assert got == brute(rows) and len(got) == len(rows)


def test_odd_rows(spark):
    rows = [(5, None, 1), (3, "", 2), (7, "a b c d", 3), (7, "a b c d", 3), (None, "a b c d", 4), (None, "alone here now", 5), (9, "A B C D", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.groups(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (7, 7), (7, 7), (None, 7), (None, None), (9, 7)], key=str)
    kept = sorted(((r.doc_id, r.text, r.fp) for r in simhash.deduplicate(df).collect()), key=str)
    assert kept == sorted([(3, "", 2), (7, "a b c d", 3), (None, "alone here now", 5)], key=str)
    assert simhash.groups(df.limit(0)).count() == 0
