"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints of 64 bits link at MAX_BITS = 3 or fewer differing bits. Of two halves of 32 bits, one then
differs in at most one bit. In each half the anchors are the code words of the Hamming code [31, 26], which
covers its 31 bits with radius 1: every half lies within 1 of exactly one anchor, its home. A half within 1
of another is within 1 + 1 of the other's home, so replicating each fingerprint to all anchors within
covering radius plus threshold (16 of them) and comparing homes with replicas at each anchor loses no link.
Of two homes the larger one is enough, which halves the replicas. Only distinct fingerprints take part;
copies are counted, never paired. An anchor is a value of 31 bits, so chance meetings stay rare: of n
fingerprints, two meet by chance at about n^2 / 2^21 anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import connected_components, materialize, ready

MAX_BITS, SHINGLE, SEED = 3, 3, 42
#: Hashes counted at a time, so that a huge text needs bounded memory.
PART = 1 << 15

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def simhash(text: str, words: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash: bit set if set in over half of the hashes of all word shingles, repeats included.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are joined by one space and
    hashed by XXH64. Fewer words than a shingle's: the whole sequence; none: 0.
    """
    tokens = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(tokens) > words:
        starts, ends = starts[:len(tokens) - words + 1], ends[words - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    votes = np.zeros(64, np.int64)
    h = xxhash.xxh64_intdigest
    for at in range(0, len(starts), PART):
        hashes = np.fromiter((h(line[a:b], SEED) for a, b in zip(starts[at:at + PART].tolist(), ends[at:at + PART].tolist(), strict=True)), np.uint64)
        votes += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, x (hash of the raw text), fp (the fingerprint's bits as a signed long), one row per row; null counts as empty."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t or "", words) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["doc_id", "x", "fp"])

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("x"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, x long, fp long")


def _syndrome(half: np.ndarray) -> np.ndarray:
    """Of 31-bit words: the position (1 to 31) whose flip gives a code word, 0 for a code word."""
    out = np.zeros_like(half)
    for i in range(31):
        out ^= np.where(half >> i & 1, i + 1, 0)
    return out


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp -> its home in each half, and the larger anchors within covering radius plus threshold."""
    pairs = [[(i, i ^ s) for i in range(1, 32) if i < i ^ s] for s in range(32)]
    # flips[s]: words to be xored to reach all anchors within 2, for syndrome s; the first is the home
    flips = np.zeros((32, 16), np.int64)
    for s in range(32):
        home = 1 << s - 1 if s else 0
        reach = [home] + ([(1 << i - 1) | (1 << j - 1) for i, j in pairs[s]] if s else [])
        flips[s, :len(reach)] = reach
        flips[s, len(reach):] = home  # a code word has no other anchor within 2
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for half in (0, 1):
            word = (fp >> (32 * half)) & 0x7FFFFFFF
            reach = word[:, None] ^ flips[_syndrome(word)]
            home = reach[:, 0]
            for col in range(16):
                keep = np.full(len(fp), True) if col == 0 else reach[:, col] > home
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reach[keep, col] * 2 + half), pa.array(fp[keep]), pa.array(np.full(int(keep.sum()), col == 0))], ["anchor", "fp", "home"])


def links(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints (column fp) within MAX_BITS, each once per anchor where they meet."""
    ready(prints.sparkSession)
    spots = prints.select("fp").distinct().mapInArrow(_anchors, "anchor long, fp long, home boolean")
    spots, _ = materialize(spots, "anchors")
    # a plain equi-join: AQE splits an anchor that many fingerprints share
    homes = spots.where("home").select(F.col("anchor").alias("at"), F.col("fp").alias("a"))
    near = homes.join(spots.select("anchor", F.col("fp").alias("b"), "home"), F.col("at") == F.col("anchor"))
    near = near.where(F.col("a") != F.col("b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).where("NOT home OR a < b")
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def groups(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, x, fp, component_id (the smallest doc_id reachable by links, itself included).

    Equal fingerprints link, those of empty texts too. Null doc_ids are passed over unless a component has
    no other. Repeated rows share their component. An empty table gives no rows.
    """
    prints, _ = materialize(fingerprints(docs, words), "fingerprints")
    classes, _ = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    found, _ = materialize(connected_components(links(classes)).select(F.col("node").alias("fp"), "component"), "components")
    # one row per fingerprint from here on, until the rows get their class
    member = classes.join(found, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    lowest = member.groupBy("component").agg(F.min("first").alias("component_id"))
    named, _ = materialize(member.join(lowest, "component").select("fp", "component_id"), "classes")
    return prints.join(named, "fp").select("doc_id", "x", "fp", "component_id")


def deduplicate(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: one per component, with the smallest doc_id; all columns (see ``keep_first``)."""
    return keep_first(docs, groups(docs, words))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay of groups as ``groups`` gives them: one per component, with the smallest doc_id.

    Where several rows have that doc_id, one with the smallest hash of its text stays. Rows without a
    doc_id stay only in a component without any, one of them.
    """
    kept = (found.where("doc_id <=> component_id").groupBy(F.col("doc_id").alias("__id"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("__null"))
            .agg(F.min("x").alias("__kx"), F.count(F.lit(1)).alias("__n")).drop("__null"))
    rows = docs.withColumn("__x", F.xxhash64(F.coalesce("text", F.lit(""))))
    stay = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__x") == F.col("__kx")))
    many = stay.where("__n > 1").dropDuplicates(["doc_id", "__x"])
    return stay.where("__n = 1").union(many).select(*docs.columns)
