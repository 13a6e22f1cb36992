"""The near-copy stage of the pipeline against exact similarities of all pairs."""

import random

import corpus_pipeline

from custodia.llm import exact_dedup, near_dup

from .conftest import components



def wanted(rows):
    ids = sorted(rows)
    sets = {i: near_dup.shingles(rows[i] or "") for i in ids}
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if near_dup.similarity(sets[a], sets[b]) >= 0.8]
    return {i for i, c in components(ids, pairs).items() if i == c}, len(pairs)


def test_shingles():
    assert near_dup.shingles("") == near_dup.shingles(" \n") == set()
    assert near_dup.shingles("One  two") == {b"one two"}
    assert near_dup.shingles("a b c d E f") == {b"a b c d e", b"b c d e f"}
    assert near_dup.similarity(set(), set()) == 1 and near_dup.similarity({1, 2, 3, 4}, {1, 2, 3, 4, 5}) == 0.8


def test_planted_copies_go(spark):
    """Copies spread from similarity 0.7 to 1, which differ in more than 3 bits of a SimHash, and chains of them."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    rows = {}
    for base in range(60):
        words = [word() for _ in range(draw.choice((40, 200, 600)))]
        for _ in range(4):
            rows[len(rows)] = " ".join(words)
            for _ in range(max(1, round(len(words) * draw.uniform(0.002, 0.03)))):
                words[draw.randrange(len(words))] = word()
    for i in range(80):  # one common passage, and one group around a centre
        rows[len(rows)] = "the same line stands in many of these texts " + " ".join(word() for _ in range(20))
        rows[len(rows)] = " ".join([*map(str, range(100)), word()])
    stay, pairs = wanted(rows)
    assert pairs > 3100
    df = spark.createDataFrame([(i, t, "c") for i, t in rows.items()], "doc_id long, text string, source string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()} == stay


def test_stage_on_the_tables(spark, sf_dir):
    docs = exact_dedup.deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    stay, pairs = wanted(rows)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()} == stay
    assert pairs > 0


def test_odd_rows(spark):
    rows = [(5, None, 1), (3, "", 2), (7, "a b c d", 3), (7, "a b c d", 3), (None, "a b c d", 4), (None, "alone here now", 5), (9, "A B C D", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.component_id) for r in near_dup.groups(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (7, 7), (7, 7), (None, 7), (None, None), (9, 7)], key=str)
    kept = sorted(((r.doc_id, r.text, r.fp) for r in near_dup.deduplicate(df).collect()), key=str)
    assert kept == sorted([(3, "", 2), (7, "a b c d", 3), (None, "alone here now", 5)], key=str)
    assert near_dup.groups(df.limit(0)).count() == 0


def test_a_family_below_the_threshold_in_small_cells(spark, monkeypatch):
    """Many texts that resemble each other at 0.5 to 0.85: few link, all share buckets; cells of a few sets each."""
    draw = random.Random(12)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    base = [word() for _ in range(150)]
    rows = {}
    for i in range(200):
        words = list(base)
        for _ in range(draw.randrange(1, 9)):
            words[draw.randrange(len(words))] = word()
        rows[i] = " ".join(words)
    stay, pairs = wanted(rows)
    assert 20 < len(stay) < 150 and pairs > 100
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for sets in (near_dup.CELL_SETS, 13):
        monkeypatch.setattr(near_dup, "CELL_SETS", sets)
        assert {r.doc_id for r in near_dup.deduplicate(df).collect()} == stay


def test_sketch():
    x, y = near_dup.sketch("a b c d e f g"), near_dup.sketch("A  b c\nd e f g ")
    assert x == y and x[1] == 3 and len(x[3]) == near_dup.BANDS and len(x[4]) == near_dup.BANDS * near_dup.ROWS
    assert near_dup.sketch("") == (0, 0, 0, [], b"") and near_dup.ALIKE == 102
