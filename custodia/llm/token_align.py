"""Cross-tokenizer alignment by products of sparse incidence matrices.

Two tokenizers cut the same bytes. With A and B the token x byte incidence matrices of a text, the row product
A B^T holds the tokens that overlap. Where both tokenizers end a token, no overlap crosses; the runs of overlap
between such cuts are the groups. With G and H the group x id incidence matrices of both sides, the outer
products of their rows hold the links of a group, each id pair with its number of occurrences. All matrices are
CSR, built by hand; products are Gustavson's, a whole run of rows at a time.

The matrices of a text are block diagonal: both tokenizers cut at certain white space whatever surrounds it, so
a text falls into segments (a word with what clings to it) whose blocks do not touch. Equal segments have equal
blocks, so a worker builds the block of a segment once and remembers it, in bounded memory.

How often an id pair is linked is a matter of the whole corpus. A worker takes documents in blocks of bounded
size, counts in how many documents of its block each pair is linked, and keeps each document's pairs as numbers
into the block's list. Spark adds the counts up, and each block gets the totals of its own pairs back, by joins
on the pair and on the block. No table of pairs is ever held whole by one task or the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from custodia.llm.common import materialize, ready

#: Segments, and linked id pairs of segments, that a worker remembers.
REMEMBER, REMEMBER_PAIRS = 600_000, 6_000_000
#: Pairs of documents that are counted together as one block.
BLOCK = 3_000_000
#: Links expanded at a time in one product, so that a huge group needs bounded memory beyond its distinct pairs.
PART = 4_000_000

_ALIGNERS: dict[tuple[str, str], Aligner] = {}


class CSR:
    """A sparse matrix of whole numbers: row i has the columns ``at[start[i]:start[i + 1]]`` with ``value`` there."""

    def __init__(self, start: np.ndarray, at: np.ndarray, value: np.ndarray, width: int):
        self.start, self.at, self.value, self.width = start, at, value, width

    @classmethod
    def of(cls, row: np.ndarray, col: np.ndarray, value: np.ndarray, shape: tuple[int, int]) -> CSR:
        """Entries in any order; those of one place add up."""
        key = row * shape[1] + col
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        total = np.add.reduceat(value, first) if len(first) else value
        row, col = np.divmod(key[first], shape[1])
        return cls(np.searchsorted(row, np.arange(shape[0] + 1)), col, total, shape[1])

    def transpose(self) -> CSR:
        return CSR.of(self.at, self.rows(), self.value, (self.width, len(self.start) - 1))

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    def times(self, other: CSR) -> CSR:
        """Gustavson's product: a row of the result is the sum of those rows of ``other`` that this row names."""
        n = np.diff(other.start)[self.at]
        spot = runs(other.start[self.at], n)
        return CSR.of(np.repeat(self.rows(), n), other.at[spot], np.repeat(self.value, n) * other.value[spot], (len(self.start) - 1, other.width))


def runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for n numbers, for each start in turn."""
    return np.arange(n.sum()) + np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n)


def incidence(lengths: np.ndarray) -> CSR:
    """Token x byte: tokens of these lengths, one behind the other."""
    start = np.concatenate(([0], np.cumsum(lengths)))
    return CSR(start, np.arange(start[-1]), np.ones(start[-1], np.int64), int(start[-1]))


def overlap_groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of either side, for token lengths of both sides with the same sum."""
    overlap = incidence(a).times(incidence(b).transpose())
    i, j = overlap.rows(), overlap.at
    # in order of bytes, one step of both sides at once means that both ended there
    cut = (np.diff(i) == 1) & (np.diff(j) == 1)
    group = np.concatenate(([0], np.cumsum(cut)))
    of_a, of_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    of_a[i], of_b[j] = group, group
    return of_a, of_b


def group_links(group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray, groups: int, owner: np.ndarray,
                owners: int, size_a: int, size_b: int) -> CSR:
    """Owner x id pair (a * size_b + b): how many token pairs of one group, in groups that ``owner`` gives to it, have these ids."""
    g = CSR.of(group_a, ids_a, np.ones(len(ids_a), np.int64), (groups, size_a))
    h = CSR.of(group_b, ids_b, np.ones(len(ids_b), np.int64), (groups, size_b))
    rows = g.rows()
    n = np.diff(h.start)[rows]  # entries of the outer product for each entry of g
    own, keys, values = [], [], []
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right")))
        part = slice(at, to)
        spot = runs(h.start[rows[part]], n[part])
        where = np.repeat(owner[rows[part]], n[part])
        key = np.repeat(g.at[part], n[part]) * size_b + h.at[spot]
        value = np.repeat(g.value[part], n[part]) * h.value[spot]
        order = np.lexsort((key, where))
        where, key, value = where[order], key[order], value[order]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(where) != 0) | (np.diff(key) != 0)))) if len(key) else np.zeros(0, np.int64)
        own.append(where[first])
        keys.append(key[first])
        values.append(np.add.reduceat(value, first) if len(first) else value)
        at = to
    if not own:
        return CSR(np.zeros(owners + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), size_a * size_b)
    where, key, value = np.concatenate(own), np.concatenate(keys), np.concatenate(values)
    if len(own) > 1:  # an owner's entries may lie in two parts
        order = np.lexsort((key, where))
        where, key, value = where[order], key[order], value[order]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(where) != 0) | (np.diff(key) != 0))))
        where, key, value = where[first], key[first], np.add.reduceat(value, first)
    return CSR(np.searchsorted(where, np.arange(owners + 1)), key, value, size_a * size_b)


#: White space that is not a lone space or line feed between other characters; then segments are found the slow way.
_ODD = re.compile(r"\s\s|[^\S\n ]|\x00")
_CUTS = re.compile(r"(?<=\S)(?= )|(?<=\S\n)(?=\S)")


def segments(line: str) -> list[str]:
    """``line`` cut where both tokenizers cut whatever stands around: before a space behind another character than
    white space, and behind a line feed that has such characters on both sides."""
    if _ODD.search(line):
        return [s for s in _CUTS.split(line) if s]
    return [s for s in line.replace(" ", "\0 ").replace("\n", "\n\0").split("\0") if s]


class Aligner:
    """Aligns the tokens of a byte-level tokenizer file (A) with those of a piece model (B).

    ``size_a`` and ``size_b`` bound the ids. Segments are numbered; their blocks are kept in flat arrays.
    """

    def __init__(self, path_a: str, path_b: str):
        import os

        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        model = sentencepiece_model_pb2.ModelProto()
        with open(path_b, "rb") as f:
            model.ParseFromString(f.read())
        model.normalizer_spec.add_dummy_prefix = False  # the space is part of the first segment
        pieces = [p.piece for p in model.pieces]
        if any(" " in p or "\n" in p or re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces reach over white space, so that segments do not stand alone")
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.size_a, self.size_b = self.a.get_vocab_size(), len(pieces)
        plain = byte_letters()
        self.bytes_a = [b""] * self.size_a
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(plain[c] for c in token) if all(c in plain for c in token) else token.encode()
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x([0-9A-F]{2})>", p)) else p.replace("▁", " ").encode() for p in pieces]
        self.width_a, self.width_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        # ids in decimal with what may follow: next of the side, the other side, the next group
        self.marks = np.array([f"{i}{c}" for c in ",|;" for i in range(max(self.size_a, self.size_b))], object)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self.facts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links; -1: bytes differ from the segment's
        self.start, self.keys, self.values = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, new: Sequence[str]) -> None:
        """Build the blocks of new segments."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        ids_b = self.b.encode(new, num_threads=1)
        good = []
        for s, x, y in zip(new, ids_a, ids_b, strict=True):
            raw = s.encode("utf-8", "surrogatepass")
            good.append(b"".join([self.bytes_a[i] for i in x]) == raw == b"".join([self.bytes_b[i] for i in y]))
        ids_a, ids_b = ([x if g else [] for x, g in zip(ids, good, strict=True)] for ids in (ids_a, ids_b))
        n_a, n_b = np.fromiter(map(len, ids_a), np.int64, len(new)), np.fromiter(map(len, ids_b), np.int64, len(new))
        a = np.fromiter((i for x in ids_a for i in x), np.int64, int(n_a.sum()))
        b = np.fromiter((i for x in ids_b for i in x), np.int64, int(n_b.sum()))
        if len(a):
            group_a, group_b = overlap_groups(self.width_a[a], self.width_b[b])
            groups = int(group_a[-1]) + 1
            size_a, size_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
            owner = np.zeros(groups, np.int64)
            owner[group_a] = np.repeat(np.arange(len(new)), n_a)
            found = group_links(group_a, a, group_b, b, groups, owner, len(new), self.size_a, self.size_b)
            n_groups = np.bincount(owner, minlength=len(new))
            n_links = np.bincount(owner, size_a * size_b, len(new)).astype(np.int64)
            texts = self._texts(a, b, group_a, group_b, owner, len(new))
        else:
            found = CSR(np.zeros(len(new) + 1, np.int64), a, a, 1)
            n_groups = n_links = np.zeros(len(new), np.int64)
            texts = [""] * len(new)
        facts = np.stack((n_a, n_b, n_groups, n_links), 1)
        facts[~np.array(good, bool)] = -1
        self.number.update(zip(new, range(len(self.texts), len(self.texts) + len(new)), strict=True))
        self.texts += texts
        self.facts = np.concatenate((self.facts, facts))
        self.start = np.concatenate((self.start, self.start[-1] + found.start[1:]))
        self.keys, self.values = np.concatenate((self.keys, found.at)), np.concatenate((self.values, found.value.astype(np.int32)))

    def _texts(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, owner: np.ndarray, n: int) -> list[str]:
        """The groups of each segment as ``a1,a2|b1;``, every group closed by a semicolon."""
        size = len(self.marks) // 3
        last = lambda g: np.concatenate((np.diff(g) != 0, [True]))
        code = np.concatenate((a + last(group_a) * size, b + last(group_b) * 2 * size))
        order = np.argsort(np.concatenate((group_a * 2, group_b * 2 + 1)), kind="stable")
        cells = self.marks[code[order]].tolist()
        ends = np.cumsum(np.bincount(owner[group_a], minlength=n) + np.bincount(owner[group_b], minlength=n)).tolist()
        return ["".join(cells[s:e]) for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    def align(self, texts: Sequence[str | None]) -> list[tuple]:
        """Per text: tokens of A, of B, groups, links, hash of the groups, and its linked id pairs, ascending, with their numbers."""
        if len(self.texts) > REMEMBER or len(self.keys) > REMEMBER_PAIRS:
            self.clear()
        cut = [segments(" " + t) if t else [] for t in texts]
        met = set().union(*cut)
        new = [s for s in met if s not in self.number]
        if new:
            self.learn(new)
        out = []
        for parts in cut:
            at = np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))
            facts = self.facts[at]
            if not len(at) or (facts < 0).any():
                out.append((0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            first = self.start[at]
            spot = runs(first, self.start[at + 1] - first)
            keys = self.keys[spot]
            order = np.argsort(keys)
            keys, values = keys[order], self.values[spot[order]]
            edge = np.flatnonzero(np.diff(keys, prepend=-1))
            line = "".join(map(self.texts.__getitem__, at.tolist()))[:-1]
            out.append((*facts.sum(0).tolist(), hashlib.sha256(line.encode()).hexdigest(), keys[edge], np.add.reduceat(values, edge, dtype=np.int64)))
        return out


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [i for i in range(256) if i not in own]
    return {**{chr(i): i for i in own}, **{chr(256 + k): i for k, i in enumerate(rest)}}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of two vocabulary files, built once per worker."""
    key = (path_a, path_b)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(path_a, path_b)
    return _ALIGNERS[key]


def _shrink(at: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending numbers and how often each, as compressed planes of bytes."""
    both = np.concatenate((np.diff(at, prepend=0), times)).astype("<u4")
    return zstandard.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _grow(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
    n = len(both) // 2
    return np.cumsum(both[:n]), both[n:]


def _blocks(path_a: str, path_b: str, id_type: pa.DataType, block: int):
    """Documents -> a row per document (block, its facts, its pairs as numbers), and a row per pair of a block (pair, docs)."""
    facts = ["n_a", "n_b", "n_groups", "n_links"]
    schema = pa.schema([("block", pa.int64()), ("pair", pa.int64()), ("docs", pa.int64()), ("doc_id", id_type), *((f, pa.int64()) for f in facts),
                        ("groups_sha256", pa.string()), ("links", pa.binary())])
    blank = lambda name, n: pa.nulls(n, schema.field(name).type)

    def flush(number: int, keys: list, rows: list) -> Iterator[pa.RecordBatch]:
        pairs, where, docs = np.unique(np.concatenate([r[5] for r in rows]), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(r[5]) for r in rows]).tolist()
        links = [_shrink(where[e - len(r[5]):e], r[6]) for r, e in zip(rows, ends, strict=True)]
        columns = list(zip(*(r[:4] for r in rows), strict=True))
        for at in range(0, len(rows), 1000):
            part = slice(at, at + 1000)
            n = len(rows[part])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, number)), blank("pair", n), blank("docs", n), pa.array(keys[part], id_type),
                *(pa.array(c[part], pa.int64()) for c in columns), pa.array([r[4] for r in rows[part]], pa.string()), pa.array(links[part], pa.binary())], schema=schema)
        for at in range(0, len(pairs), 1 << 16):
            n = len(pairs[at:at + (1 << 16)])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, number)), pa.array(pairs[at:at + n]), pa.array(docs[at:at + n].astype(np.int64)),
                *(blank(f, n) for f in schema.names[3:])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        keys, rows, held = [], [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), 250):
                for key, row in zip(ids[at:at + 250], own.align(texts[at:at + 250]), strict=True):
                    keys.append(key)
                    rows.append(row)
                    held += len(row[5])
                if held >= block:
                    yield from flush(number, keys, rows)
                    number, keys, rows, held = number + 1, [], [], 0
        if rows:
            yield from flush(number, keys, rows)
    return run


def _answer(id_type: pa.DataType):
    """One block: its documents, and the totals of its pairs in their order."""
    def run(rows: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        totals = totals.sort_values("pair")
        total, best = totals["total"].to_numpy(np.int64), totals["best"].to_numpy(bool)
        n_best, sums = [], []
        for raw in rows["links"]:
            at, times = _grow(raw)
            n_best.append(int(times[best[at]].sum()))
            sums.append(int((times * total[at]).sum()))
        return rows.drop(columns=["block", "links"]).assign(n_best=np.array(n_best, np.int64), count_sum=np.array(sums, np.int64))
    return run


def align(docs: DataFrame, path_a: str, path_b: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Alignments of the whole texts of ``docs`` (doc_id, text), and the table of linked id pairs.

    First: a row per row of ``docs`` with doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.
    Second: (a, b, docs, best): in how many documents the ids are linked, and whether no other partner of ``a``
    is linked in more. A is the byte-level file, which reads the text behind one space, B the piece model.

    Texts that are null or empty, and those that a tokenizer does not give back byte by byte, have no tokens:
    zeros and an empty hash. Rows that repeat count each time; all partners with the highest number are best;
    an empty table gives two empty tables. Other columns of ``docs`` are not read. A huge text is a block of its
    own, which its worker holds.
    """
    spark = ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    fields = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    id_type = to_arrow_type(kind)
    found, _ = materialize(docs.select("doc_id", "text").mapInArrow(
        _blocks(path_a, path_b, id_type, block), f"block long, pair long, docs long, doc_id {kind.simpleString()}, {fields}, links binary"), "alignments")
    size_b = aligner(path_a, path_b).size_b
    pairs = found.where("pair IS NOT NULL").select("block", "pair", "docs")
    totals, _ = materialize(pairs.groupBy("pair").agg(F.sum("docs").alias("total")).withColumn("a", F.expr(f"pair div {size_b}")), "pairs")
    highest = totals.groupBy("a").agg(F.max("total").alias("highest"))  # one row per id of A's vocabulary
    totals = totals.join(F.broadcast(highest), "a").select("pair", "a", F.expr(f"pair % {size_b}").alias("b"), "total", (F.col("total") == F.col("highest")).alias("best"))
    asked = pairs.select(F.col("block").alias("of"), "pair").join(totals.select("pair", "total", "best"), "pair").select("of", "pair", "total", "best")
    rows = found.where("pair IS NULL").drop("pair", "docs")
    out = rows.groupBy("block").cogroup(asked.groupBy("of")).applyInPandas(
        _answer(id_type), f"doc_id {kind.simpleString()}, {fields}, n_best long, count_sum long")
    return out, totals.select("a", "b", F.col("total").alias("docs"), "best")
