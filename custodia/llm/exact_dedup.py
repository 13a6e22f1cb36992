"""Exact de-duplication by composable polynomial fingerprints.

A text's fingerprint is a polynomial over its normalised UTF-8 bytes, modulo the prime 2^31 - 1, at four
points (124 bits). Fingerprints compose: ``H(xy) = H(x) * B^|y| + H(y)``, so the chunks of a huge text are
hashed by different tasks, and each chunk's hash, shifted by the bytes behind it, is simply added up.
Texts with equal length and fingerprint are then compared byte by byte, one bounded chunk at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import materialize, ready, spread

P = 2**31 - 1
#: The evaluation points; any residues of large order do.
POINTS = (1_103_515_245, 1_664_525_013, 69_069_069, 1_597_334_677)
#: Texts above CHUNK bytes are hashed in pieces of that size, and compared in such pieces.
CHUNK = 1 << 18
FP = [f"f{i}" for i in range(len(POINTS))]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo P, kept for the life of the worker."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.ones(max(n, 1024), np.int64)
        filled = 1
        while filled < len(out):
            step = min(filled, len(out) - filled)
            out[filled:filled + step] = out[:step] * pow(base, filled, P) % P
            filled += step
        _POWERS[base] = have = out
    return have[:n]


def fingerprint(data: bytes) -> tuple[int, ...]:
    """The polynomial hash of ``data`` at each of POINTS."""
    raw = np.frombuffer(data, np.uint8).astype(np.int64)[::-1] + 1  # no byte is zero, so leading bytes count
    return tuple(int(np.dot(raw, powers(b, len(raw))) % P) for b in POINTS)


def shifted(hashes: tuple[int, ...], behind: int) -> tuple[int, ...]:
    """What a chunk's hash adds to the whole text's, with ``behind`` bytes after the chunk."""
    return tuple(h * pow(b, behind, P) % P for h, b in zip(hashes, POINTS, strict=True))


def _short(chunk: int):
    """Adds n_bytes, fingerprint and SHA-256 to rows; a text above ``chunk`` bytes gets no fingerprint yet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            sizes, digests, cols = [], [], [[] for _ in FP]
            for value in texts:
                data = value.as_buffer().to_pybytes().translate(LOWER) if value.is_valid else b""
                sizes.append(len(data))
                digests.append(hashlib.sha256(data).hexdigest())
                prints = fingerprint(data) if len(data) <= chunk else (None,) * len(FP)
                for col, x in zip(cols, prints, strict=True):
                    col.append(x)
            keep = [i for i, f in enumerate(batch.schema) if f.name != "__text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep] + [pa.array(sizes, pa.int64()), pa.array(digests, pa.string())]
                + [pa.array(c, pa.int64()) for c in cols],
                [batch.schema.field(i).name for i in keep] + ["n_bytes", "text_sha256", *FP])
    return run


def _cut(chunk: int):
    """Rows whose last column is a text -> a row per piece of ``chunk`` normalised bytes, with its number k and the bytes behind it.

    A text is walked once, whatever its length: each byte is copied into one piece.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, names = batch.columns[:-1], batch.schema.names[:-1]
            for i, value in enumerate(batch.columns[-1]):
                data = value.as_buffer().to_pybytes().translate(LOWER) if value.is_valid else b""
                starts = range(0, max(1, len(data)), chunk)
                for at in range(0, len(starts), 32):
                    some = starts[at:at + 32]
                    same = pa.array([i] * len(some))
                    yield pa.RecordBatch.from_arrays(
                        [c.take(same) for c in rest] + [pa.array(range(at, at + len(some)), pa.int32()), pa.array([data[s:s + chunk] for s in some], pa.binary()),
                                                        pa.array([max(0, len(data) - s - chunk) for s in some], pa.int64())], [*names, "k", "piece", "behind"])
    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, x, piece, behind) -> the piece's shifted hash."""
    for batch in batches:
        rows = batch.to_pydict()
        out = [shifted(fingerprint(p), n) for p, n in zip(rows["piece"], rows["behind"], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("x"), batch.column("k")] + [pa.array([r[i] for r in out], pa.int64()) for i in range(len(FP))],
            ["doc_id", "x", "k", *FP])


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, x (a hash of the raw text), n_bytes, text_sha256, f0..f3.

    Null texts count as empty. Huge texts are cut into pieces of bytes, the pieces dealt out over all tasks, hashed
    there and summed; rows with the same doc_id and text share one sum.
    """
    ready(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).withColumn("x", F.xxhash64("__text"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, x long, n_bytes long, text_sha256 string, " + ", ".join(f"{f} long" for f in FP)
    short = rows.select("doc_id", "x", "__text").mapInArrow(_short(CHUNK), schema)
    huge = rows.where(F.octet_length("__text") > CHUNK).select("doc_id", "x", "__text").mapInArrow(_cut(CHUNK), f"doc_id {kind}, x long, k int, piece binary, behind long")
    parts = spread(huge, "doc_id", "x", "k").mapInArrow(
        _pieces, f"doc_id {kind}, x long, k int, " + ", ".join(f"{f} long" for f in FP))
    once = parts.groupBy("doc_id", "x", "k").agg(*[F.max(f).alias(f) for f in FP])
    sums = once.groupBy("doc_id", "x").agg(*[(F.sum(f) % P).alias(f"s{f}") for f in FP])
    joined = short.alias("a").join(
        sums.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.x") == F.col("b.x"))
        & (F.col("a.n_bytes") > CHUNK), "left")
    return joined.select("a.doc_id", "a.x", "a.n_bytes", "a.text_sha256",
                         *[F.coalesce(f"a.{f}", f"b.s{f}").alias(f) for f in FP])


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, x, text_sha256, keep_id, group_size.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. keep_id is the largest
    doc_id of the group (nulls only if there is no other). Equal fingerprints are candidates; every
    candidate's text is compared with the text of its group's keep_id, chunk by chunk, and whoever differs
    goes to another round with those that differ alike, until none does. Empty tables give no rows.
    """
    key = ["n_bytes", *FP]
    prints, _ = materialize(fingerprints(docs), "fingerprints")
    left = prints
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("x", F.xxhash64("text"))
    out = ["doc_id", "x", "text_sha256", "keep_id", "group_size"]
    done = None
    while True:
        sizes = left.groupBy(*key).agg(F.max(F.struct("doc_id", "x")).alias("top"), F.count(F.lit(1)).alias("group_size"))
        sizes = sizes.where("group_size > 1").select(*key, F.col("top.doc_id").alias("k_id"), F.col("top.x").alias("k_x"), "group_size")
        # written first: the join's two sides are then dealt out for it alone, and AQE can split a hot text
        sizes, _ = materialize(sizes, "sizes")
        marked = left.join(sizes, key, "left").select(
            "doc_id", "x", "n_bytes", "text_sha256", F.expr("if(group_size IS NULL, doc_id, k_id)").alias("keep_id"), F.col("k_x").alias("keep_x"),
            F.coalesce("group_size", F.lit(1)).alias("group_size"))
        need = marked.where("group_size > 1 AND n_bytes > 0").select("doc_id", "x", "keep_id", "keep_x").distinct()
        # the texts that share a fingerprint, in bounded pieces; one row of each (doc_id, text)
        cand = need.join(texts, need.doc_id.eqNullSafe(texts.doc_id) & (need.x == texts.x)).select(
            need.doc_id, need.x, "keep_id", "keep_x", "text")
        kind, long = dict(cand.dtypes)["doc_id"], F.octet_length("text") > CHUNK
        whole = cand.where(~long).select("doc_id", "x", "keep_id", "keep_x", F.lit(0).alias("k"), F.translate("text", UPPER, UPPER.lower()).cast("binary").alias("piece"))
        parts = cand.where(long).mapInArrow(_cut(CHUNK), f"doc_id {kind}, x long, keep_id {kind}, keep_x long, k int, piece binary, behind long").drop("behind")
        cand = whole.unionByName(parts)
        cand, _ = materialize(cand, "candidates")
        first = cand.where("doc_id <=> keep_id AND x = keep_x").dropDuplicates(["doc_id", "x", "k"])
        pieces = cand.where("NOT (doc_id <=> keep_id AND x = keep_x)").alias("m").join(
            first.alias("q"), F.col("m.keep_id").eqNullSafe(F.col("q.doc_id")) & (F.col("m.keep_x") == F.col("q.x"))
            & (F.col("m.k") == F.col("q.k")), "left")
        unequal, wrong = materialize(pieces.where("NOT (m.piece <=> q.piece)").select("m.doc_id", "m.x").distinct(), "unequal")
        if not wrong:
            return marked.select(*out) if done is None else done.union(marked.select(*out))
        # fingerprints that met by chance: the true members are settled, the others try again among themselves
        same = left.doc_id.eqNullSafe(unequal.doc_id) & (left.x == unequal.x)
        agreed = left.join(unequal, same, "left_anti")
        sizes = agreed.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        settled, _ = materialize(agreed.join(sizes, key).select(*out), "settled")
        done = settled if done is None else done.union(settled)
        left, _ = materialize(left.join(unequal, same, "left_semi"), "again")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one per group of equal texts, with the largest doc_id; all columns.

    Where rows repeat (one doc_id on equal texts) one of them stays. Rows without a doc_id stay only if no
    equal text has one.
    """
    kept = (groups(docs).where("doc_id <=> keep_id").groupBy(F.col("doc_id").alias("__id"), "text_sha256")
            .agg(F.min("x").alias("__kx"), F.count(F.lit(1)).alias("__n")).drop("text_sha256"))
    rows = docs.withColumn("__x", F.xxhash64(F.coalesce("text", F.lit(""))))
    stay = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__x") == F.col("__kx")))
    many = stay.where("__n > 1").dropDuplicates(["doc_id", "__x"])
    return stay.where("__n = 1").union(many).select(*docs.columns)
