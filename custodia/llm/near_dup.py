"""Near-duplicates by shingle similarity, exact on what is proposed: SimHash anchors and MinHash buckets propose.

Two texts link where the Jaccard similarity of their sets of WORDS-word shingles is SIMILAR or more. Pairs are
proposed by two ways. SimHash fingerprints of the sets meet at anchors of a covering code, as in ``simhash``; that
finds the closest pairs only, as two texts of similarity 0.8 differ in 9.7 of 64 bits on average. So BANDS buckets
of ROWS minima follow, which hold a pair of similarity s with probability 1 - (1 - s^ROWS)^BANDS: all but 3 in a
million at 0.8, and all but one in 10^8 at 0.85. No pair links without its exact similarity.

Only connected groups are wanted. First the anchors' pairs, and each bucket with one pivot, are compared on the
texts: that connects groups of near copies of any size with a number of pairs in proportion to the rows. What still
shares a bucket with another group is gathered into neighbourhoods, cut into cells of bounded size. A cell compares
signatures, then sets of hashes, skips what it has connected already, and gives out a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.llm import simhash
from custodia.llm.common import connected_components, materialize, ready, spread
from custodia.llm.simhash import LOWER, keep_first

WORDS, SIMILAR, BANDS, ROWS = 5, 0.8, 32, 5
#: Sets, and hashes of their shingles, in one part of a cell; a cell has one part or two.
CELL_SETS, CELL_HASHES = 500, 400_000
#: Of BANDS * ROWS minima, those that a pair of similarity SIMILAR has in common at least, but for one in 3 million (5 deviations).
ALIKE = int(BANDS * ROWS * SIMILAR - 5 * (BANDS * ROWS * SIMILAR * (1 - SIMILAR)) ** 0.5)
#: Hashes that meet all permutations at a time, so that a huge text needs bounded memory.
PART = 1 << 10

_DRAW = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
_XOR, _TIMES = _DRAW[0] * np.uint64(2), _DRAW[1] * np.uint64(2) + np.uint64(1)


def shingles(text: str, words: int = WORDS) -> set[bytes]:
    """The distinct word shingles, words as in ``simhash``; the whole sequence if it is shorter, none without words."""
    tokens = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    return {b" ".join(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def similarity(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def hashes(text: str) -> np.ndarray:
    """Hashes of the set of shingles, ascending."""
    found = shingles(text)
    return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))


def sketch(text: str) -> tuple[int, int, int, list[int], bytes]:
    """Hash of the set of shingles, its size, its SimHash, one bucket per band (none for the empty set), the minima's low bytes."""
    found = hashes(text)
    if not len(found):
        return 0, 0, 0, [], b""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(found), PART):
        part = found[at:at + PART]
        np.minimum(low, ((part ^ _XOR) * _TIMES).min(1), out=low)
        votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    buckets = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(low.reshape(BANDS, ROWS))]
    sim = np.packbits(votes * 2 > len(found), bitorder="little").view("<u8")[0]
    # the high byte of a product depends on all bits of the hash, the low one on few
    return (xxhash.xxh64_intdigest(found.tobytes()), len(found), int(sim), np.array(buckets, np.uint64).view(np.int64).tolist(),
            (low >> np.uint64(8)).astype(np.uint8).tobytes())


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, x (hash of the raw text), fp (hash of the set of shingles), n (its size), sim (its SimHash), buckets, minima; null counts as empty."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, n, sim, buckets, minima = zip(*(sketch(t or "") for t in batch.column(2).to_pylist()), strict=True) if batch.num_rows else ((),) * 5
            signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), signed(fp), pa.array(n, pa.int64()), signed(sim), pa.array(buckets, pa.list_(pa.int64())), pa.array(minima, pa.binary())],
                ["doc_id", "x", "fp", "n", "sim", "buckets", "minima"])

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("x"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, x long, fp long, n long, sim long, buckets array<long>, minima binary")


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    @lru_cache(64)
    def known(text: str) -> set[bytes]:
        return shingles(text)

    for batch in batches:
        one, two = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        good = pa.array([similarity(known(s or ""), known(t or "")) >= SIMILAR for s, t in zip(one, two, strict=True)], pa.bool_())
        yield batch.select([0, 1]).filter(good)


def texts_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(fp, text): one text of each wanted set of shingles (column fp)."""
    places = wanted.join(classes.select("fp", "x"), "fp").select("fp", "x")
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("x"), "text").join(places, "x")
    return texts.groupBy("fp").agg(F.first("text").alias("text"))


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of sets whose texts are similar, each once."""
    pairs, n = materialize(pairs.distinct(), "pairs")
    if not n:
        return pairs
    texts, _ = materialize(texts_of(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct(), classes, docs), "texts")
    both = (pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("s")), "a")
            .join(texts.select(F.col("fp").alias("b"), F.col("text").alias("t")), "b").select("a", "b", "s", "t"))
    return materialize(both.mapInArrow(_confirmed, "a long, b long"), "links")[0]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [hashes(t or "").tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["fp", "hashes"])


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    """One cell's spanning forest: sets of different groups whose similarity is SIMILAR or more.

    A cell of two parts leaves pairs within one part to the cell of that part alone.
    """
    rows = rows.sort_values("fp")
    fp, part, minima = rows["fp"].to_numpy(), rows["part"].to_numpy(), np.stack([np.frombuffer(m, np.uint8) for m in rows["minima"]])
    sets = [np.frombuffer(h, np.uint64) for h in rows["hashes"]]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    group = np.unique(rows["c"].to_numpy(), return_inverse=True)[1]
    two = part.min() != part.max()
    out = []
    for i in range(len(fp) - 1):
        after = np.flatnonzero(group[i + 1:] != group[i]) + i + 1
        if two:
            after = after[part[after] != part[i]]
        after = after[np.minimum(size[after], size[i]) >= SIMILAR * np.maximum(size[after], size[i])]
        after = after[np.count_nonzero(minima[after] == minima[i], axis=1) >= ALIKE] if len(after) else after
        if not len(after):
            continue
        # shared hashes of this set and each of the others, all at once
        every, ends = np.concatenate([sets[j] for j in after]), np.cumsum(size[after])
        spot = np.minimum(np.searchsorted(sets[i], every), size[i] - 1)
        hits = np.concatenate(([0], np.cumsum(sets[i][spot] == every)))
        both = hits[ends] - hits[ends - size[after]]
        for j in after[both / (size[i] + size[after] - both) >= SIMILAR]:
            if group[j] != group[i]:
                out.append((fp[i], fp[j]))
                group[group == group[j]] = group[i]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def across(spots: DataFrame, first: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): a forest of links between sets that share a bucket while their groups (``first``: node, component) differ."""
    named = spots.join(first, spots.fp == first.node, "left").select("bucket", "fp", F.coalesce("component", "fp").alias("c"))
    mixed = named.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("bucket", "low")
    rest, _ = materialize(named.join(mixed, "bucket"), "buckets")
    # neighbourhoods: groups that are connected by shared buckets
    near, _ = materialize(connected_components(rest.select(F.col("c").alias("a"), F.col("low").alias("b")), "neighbourhoods"), "neighbourhoods")
    members = rest.select("fp", "c").distinct()
    found = texts_of(members.select("fp"), classes, docs).mapInArrow(_hashed, "fp long, hashes binary")
    sets = (members.join(near, members.c == near.node).select("fp", "c", F.col("component").alias("area"))
            .join(classes.select("fp", "n", "minima"), "fp").join(found, "fp"))
    sets, _ = materialize(sets, "sets")
    sizes = sets.groupBy("area").agg(F.greatest(F.ceil(F.sum("n") / CELL_HASHES), F.ceil(F.count(F.lit(1)) / CELL_SETS)).cast("int").alias("parts"))
    cut = sets.join(sizes, "area").withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cut.select("area", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp", "c", "minima", "hashes")
    key = ["area", "i", "j"]
    return materialize(spread(cells, *key).groupBy(*key).applyInPandas(_cell, "a long, b long"), "links")[0]


def components(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, component) of all sets of shingles (fp, x, n, sim, buckets, minima) that link to another."""
    ready(docs.sparkSession)
    # sizes further apart than SIMILAR allow no such similarity
    sized = f"least({{0}}, {{1}}) >= {SIMILAR} * greatest({{0}}, {{1}})"
    # one set stands for those with its SimHash; anchors find the others within simhash.MAX_BITS
    owners, _ = materialize(classes.groupBy("sim").agg(F.min("fp").alias("owner")), "owners")
    same = classes.join(owners, "sim").where("fp <> owner").select(F.col("owner").alias("a"), F.col("fp").alias("b"))
    near = simhash.links(owners.select(F.col("sim").alias("fp"))).distinct()
    near = (near.join(owners.select(F.col("sim").alias("a"), F.col("owner").alias("c")), "a")
            .join(owners.select(F.col("sim").alias("b"), F.col("owner").alias("d")), "b").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")))
    spots = classes.select("fp", "n", F.explode("buckets").alias("bucket"))
    shared = spots.groupBy("bucket").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.min_by("n", "fp").alias("low_n")).where("low <> high")
    spots, _ = materialize(spots.join(shared.select("bucket", "low", "low_n"), "bucket"), "buckets")
    stars = spots.where("fp <> low").where(sized.format("n", "low_n")).select(F.col("low").alias("a"), F.col("fp").alias("b"))
    first, _ = materialize(connected_components(confirm(stars.union(near).union(same), classes, docs)), "components")
    more = across(spots, first, classes, docs)
    return connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more.select("a", "b")))


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, x, fp, component_id (the smallest doc_id reachable by links, itself included).

    Equal sets of shingles link, those of empty texts too. Null doc_ids are passed over unless a component has
    no other. Repeated rows share their component. An empty table gives no rows.
    """
    prints, _ = materialize(sketches(docs), "sketches")
    classes, _ = materialize(prints.groupBy("fp").agg(
        F.min("doc_id").alias("first"), F.min("x").alias("x"), F.first("n").alias("n"),
        F.first("sim").alias("sim"), F.first("buckets").alias("buckets"), F.first("minima").alias("minima")), "classes")
    found, _ = materialize(components(classes, docs).select(F.col("node").alias("fp"), "component"), "components")
    member = classes.join(found, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    lowest = member.groupBy("component").agg(F.min("first").alias("component_id"))
    named, _ = materialize(member.join(lowest, "component").select("fp", "component_id"), "classes")
    return prints.select("doc_id", "x", "fp").join(named, "fp").select("doc_id", "x", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one per component, with the smallest doc_id; all columns (see ``simhash.keep_first``)."""
    return keep_first(docs, groups(docs))
