"""Order-preserving packing: windows of at most WINDOW tokens, cut by dynamic programming.

Documents are read in the order in which they are stored; each partition packs its own run of them. A cut
may fall at a document's end (free), at a sentence's end (SENTENCE) or, where sentences are long, at fixed
steps inside one (HARD). The cost of a window is its padding plus the penalty of its last cut. With p the
positions, the best cost up to j is WINDOW - p[j] + penalty[j] + min(best[i] + p[i]) over the i within
reach, and a monotone queue keeps that minimum, so the work is linear in the number of positions.

A worker holds about SPAN tokens: when these are there, it solves the problem for them, gives out all
windows but the last, and goes on with what the last one held. Nothing is shuffled.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import ready

WINDOW, END_ID = 4096, 2
#: Penalties, as padding tokens; the step of the positions inside a sentence.
SENTENCE, HARD, STEP = 2, 8, 16
SPAN = 1 << 20
#: Words that a worker remembers with their ids before it forgets those not met since the last such moment; the longest such word.
REMEMBER, LONG_WORD = 450_000, 64

_TOKENIZERS: dict[str, WordIds] = {}
#: White space to str.split but not to the tokenizer.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: A full stop or comma beside another mark, with which the tokenizer would join it.
_JOINED = re.compile(r"[.,](?:(?=[^\w\s]|_)|(?<=[^\w\s][.,])|(?<=_[.,]))")


class WordIds:
    """Ids of whole texts by a tokenizer that drops white space, so that a text's ids are those of its words.

    Each word is encoded once and remembered, in a bounded memory. Texts with control characters on whose
    class Python and the tokenizer differ are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.stops = np.array(sorted(i for t, i in vocab.items() if re.fullmatch(r"[.!?]+[\"')\]]*(</w>)?", t)), np.uint32)

    @staticmethod
    def words(text: str) -> list[str] | None:
        """Words of a text whose ids, one behind the other, are those of the text; None where it must be encoded whole.

        A full stop or comma beside letters, digits or white space only is a pre-token of its own, so it is set
        apart, where normalising leaves no mark beside it. The tokenizer drops case, so that goes where one
        letter's case depends on nothing around it.
        """
        if _SEPARATORS.search(text):
            return None
        try:
            text.encode("latin-1")
            text = text.lower()
            plain = True
        except UnicodeEncodeError:
            plain = "\u0130" not in text and unicodedata.is_normalized("NFC", text)
        if plain and not _JOINED.search(text):
            text = text.replace(".", " . ").replace(",", " , ")
        return text.split()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.memory) > REMEMBER:
            self.memory, self.older = {}, self.memory
        known = self.memory.get
        words = [self.words(t) for t in texts]
        found = [None if ws is None else list(map(known, ws)) for ws in words]
        new = set()
        for ws, ids in zip(words, found, strict=True):
            if ids and None in ids:
                new.update([w for w, i in zip(ws, ids, strict=True) if i is None])
        fresh = self._learn(new)
        out = []
        for t, ws, ids in zip(texts, words, found, strict=True):
            if ids is None:
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4"))
                continue
            if None in ids:
                ids = [fresh[w] if i is None else i for w, i in zip(ws, ids, strict=True)]
            out.append(np.frombuffer(b"".join(ids), "<u4"))
        return out

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not remembered, or were longer ago; those that are not too long are remembered."""
        found = {w: self.older[w] for w in words if w in self.older}
        new = [w for w in words if w not in found]
        ids = [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        found.update(zip(new, ids, strict=True))
        self.memory.update(found if max(map(len, new), default=0) <= LONG_WORD else {w: i for w, i in found.items() if len(w) <= LONG_WORD})
        return found


def tokenizer(path: str) -> WordIds:
    """The tokenizer at ``path``, loaded once per worker."""
    if path not in _TOKENIZERS:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def positions(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Where ``ids`` may be cut (from 0 to its length) and each cut's penalty; ``ends`` are the documents' ends."""
    sentence = np.flatnonzero(np.isin(ids, stops)) + 1
    at = np.unique(np.concatenate(([0], ends, sentence)))
    gaps = np.diff(at)
    more = [np.arange(a + step, b, step) for a, b in zip(at[:-1][gaps > 2 * step].tolist(), at[1:][gaps > 2 * step].tolist(), strict=True)]
    every = np.unique(np.concatenate([at, *more])) if more else at
    penalty = np.full(len(every), HARD, np.int64)
    penalty[np.searchsorted(every, sentence)] = SENTENCE
    penalty[np.searchsorted(every, ends)] = 0
    penalty[0] = 0
    return every, penalty


def cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Positions (the first and last included) that split a run at the least padding plus penalties.

    Every gap between neighbours must fit the window.
    """
    p, pen = at.tolist(), penalty.tolist()
    key, back = [0] * len(p), [0] * len(p)
    key[0] = p[0]
    queue = deque([0])
    for j in range(1, len(p)):
        here = p[j]
        while here - p[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        back[j] = i
        k = window + pen[j] + key[i]  # best cost up to j, plus p[j]
        key[j] = k
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    out, j = [], len(p) - 1
    while j:
        out.append(p[j])
        j = back[j]
    return [p[0], *out[::-1]]


def tail(start: int, end: int, window: int = WINDOW) -> list[int]:
    """How the last window ends: sequences at a power of two are not padded, so a short rest is split into such
    lengths where that costs less than its padding."""
    rest, out = end - start, []
    while rest and (rest & (rest - 1)) and window - rest > HARD * (bin(rest).count("1") - 1):
        size = 1 << (rest.bit_length() - 1)
        start += size
        out.append(start)
        rest = end - start
    return [*out, end] if rest else out


class Packer:
    """Packs the documents that it is given, in order, into numbered sequences."""

    def __init__(self, stops: np.ndarray, first: int, window: int = WINDOW, span: int = SPAN):
        self.stops, self.sequence, self.window, self.span = stops, first, window, span
        self.docs: list[tuple] = []  # (key, ids still to be packed, ids before these, ids in all)
        self.held = 0

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        """Pieces that are settled now: (key, start, ids, ids of the document, sequence, offset)."""
        self.docs.append((key, ids, 0, len(ids)))
        self.held += len(ids)
        if self.held >= self.span:
            yield from self._pack(False)

    def finish(self) -> Iterator[tuple]:
        if self.held:
            yield from self._pack(True)

    def _pack(self, last: bool) -> Iterator[tuple]:
        ids = np.concatenate([d[1] for d in self.docs])
        ends = np.cumsum([len(d[1]) for d in self.docs])
        found = cuts(*positions(ids, ends, self.stops), self.window)
        if last:
            found = found[:-1] + tail(found[-2], found[-1], self.window)
        elif len(found) > 2:
            found = found[:-1]
        done = found[-1]
        marks = np.union1d(found, ends[ends <= done])
        doc = np.searchsorted(ends, marks[:-1], "right")
        seq = np.searchsorted(found, marks[:-1], "right") - 1
        begins = ends - np.array([len(d[1]) for d in self.docs])
        for a, b, k, s in zip(marks[:-1].tolist(), marks[1:].tolist(), doc.tolist(), seq.tolist(), strict=True):
            key, _, before, total = self.docs[k]
            yield key, before + a - int(begins[k]), ids[a:b], total, self.sequence + s, a - found[s]
        self.sequence += len(found) - 1
        left = []
        for (key, part, before, total), begin, end in zip(self.docs, begins.tolist(), ends.tolist(), strict=True):
            if end > done:
                skip = max(0, done - begin)
                left.append((key, part[skip:].copy(), before + skip, total))
        self.docs, self.held = left, int(ends[-1]) - done


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (unsigned 32-bit, little-endian), doc_tokens, sequence_id, offset.

    A document is its text's ids and then ``end_id``; a null text counts as empty, so each row of ``docs``
    has a piece. Sequences are numbered from the partition's number times 2^40. Rows that repeat are packed
    each time; an empty table gives no pieces.
    """
    ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def batch_of(rows):
        key, start, ids, total, sequence, offset = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([
            pa.array(key, id_type), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
            pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(total, pa.int64()),
            pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        packer = Packer(words.stops, TaskContext.get().partitionId() << 40, window)
        end = np.array([end_id], "<u4")
        rows, held = [], 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for key, ids in zip(keys, words.encode(texts), strict=True):
                for piece in packer.add(key, np.concatenate((ids, end))):
                    rows.append(piece)
                    held += len(piece[2])
                    if held > 1 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
        rows += packer.finish()
        if rows:
            yield batch_of(rows)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the CRC-32 of their ids in place of these."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
