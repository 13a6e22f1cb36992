"""Byte-level BPE by ranks: encoding with a two-tier lookup, and decoding.

A text is split by a pattern into pre-tokens. First tier: a minimal perfect hash over the vocabulary maps a
pre-token to one slot, whose bytes are compared, so a whole pre-token of the vocabulary is resolved at once.
Second tier: the bytes of any other are linked, and a heap gives out the adjacent pair of lowest rank,
leftmost first, until none has a rank. Workers remember pre-tokens they have met, in bounded memory.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import ready

#: Pre-tokens that a worker remembers, and the longest of them.
REMEMBER, LONG = 500_000, 64
_CODERS: dict[tuple[str, str], Coder] = {}


class PerfectHash:
    """A minimal perfect hash of byte strings: levels of bit sets, the rank of a key's first single hit is its slot.

    On each level the keys left over are hashed into twice as many bits; those that are alone on their bit
    stay there, the others go on to the next level.
    """

    def __init__(self, keys: list[bytes]):
        self.levels: list[tuple[int, bytes, list[int]]] = []
        left, slots = list(keys), 0
        while left:
            size = max(64, 2 * len(left) // 64 * 64 + 64)
            seed = len(self.levels)
            spots = np.array([xxhash.xxh64_intdigest(k, seed) % size for k in left])
            alone = np.bincount(spots, minlength=size) == 1
            before = slots + np.concatenate(([0], np.cumsum(alone)[:-1]))
            self.levels.append((size, alone.tobytes(), before.tolist()))
            slots += int(alone.sum())
            left = [k for k, one in zip(left, alone[spots].tolist(), strict=True) if not one]
            if seed > 200:
                raise ValueError("keys repeat")

    def slot(self, key: bytes) -> int:
        """The slot of a key, any slot or -1 for other strings."""
        for seed, (size, alone, before) in enumerate(self.levels):
            spot = xxhash.xxh64_intdigest(key, seed) % size
            if alone[spot]:
                return before[spot]
        return -1


class Memory(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, coder: Coder):
        super().__init__()
        self.coder = coder

    def __missing__(self, token: str) -> bytes:
        ids = np.array(self.coder.ids(token.encode("utf-8")), "<u4").tobytes()
        if len(token) <= LONG:
            self[token] = ids
        return ids


def newer_characters() -> frozenset[str]:
    """Characters that the regex module takes for letters or numbers and the tiktoken library does not, its Unicode tables being older."""
    import regex
    import tiktoken
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        # characters outside the pattern are dropped by the library
        known = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        out |= set(regex.findall(kind, every)) - set(bytes(known.encode_ordinary(every)).decode("utf-8"))
    return frozenset(out)


class Coder:
    """Encoder and decoder of one rank file (base64 token and rank a line) and one pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(t): int(r) for t, r in pairs}
        self.pattern = regex.compile(pattern)
        self.newer = newer_characters()
        self.beyond = re.compile(f"[{min(self.newer)}-\U0010ffff]").search if self.newer else lambda _: None
        keys = list(self.ranks)
        self.hash = PerfectHash(keys)
        self.keys: list[bytes] = [b""] * len(keys)
        self.slot_ids = [0] * len(keys)
        for k in keys:
            s = self.hash.slot(k)
            self.keys[s], self.slot_ids[s] = k, self.ranks[k]
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for k, r in self.ranks.items():
            self.tokens[r] = k
        self.memory = Memory(self)

    def ids(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        s = self.hash.slot(piece)
        if s >= 0 and self.keys[s] == piece:
            return [self.slot_ids[s]]
        return self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Lowest-rank merges by a heap over linked parts."""
        n, ranks = len(piece), self.ranks
        nxt, prev, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(piece[i:i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i] if end[i] else n
            # stale if the left part is gone or either part has grown since
            if not end[i] or j >= n or end[j] != stop or end[i] != j:
                continue
            end[i], end[j] = stop, 0
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                r = ranks.get(piece[i:end[k]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            h = prev[i]
            if h >= 0:
                r = ranks.get(piece[h:stop])
                if r is not None:
                    heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = nxt[i]
        return out

    def encode(self, text: str) -> bytes:
        if len(self.memory) > REMEMBER:
            self.memory.clear()
        return b"".join(map(self.memory.__getitem__, self.split(text)))

    def split(self, text: str) -> list[str]:
        """Pre-tokens as the tiktoken library cuts them."""
        if self.beyond(text) and not self.newer.isdisjoint(text):
            # to the library these are neither letters nor numbers, like a private-use character
            plain = "".join("\ue000" if c in self.newer else c for c in text)
            return [text[m.start():m.end()] for m in self.pattern.finditer(plain)]
        return self.pattern.findall(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder(path: str, pattern: str) -> Coder:
    """The coder of a rank file and a pattern, built once per worker."""
    key = (path, pattern)
    if key not in _CODERS:
        _CODERS[key] = Coder(path, pattern)
    return _CODERS[key]


def _mapped(df: DataFrame, source: str, target: str, path: str, pattern: str, how: str) -> DataFrame:
    """``df`` with one more binary column; columns keep their names, an old one called ``target`` is replaced."""
    ready(df.sparkSession)
    rest = [c for c in df.columns if c != target]
    at = rest.index(source)
    # positions, not names, so that the table's names may clash with anything
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(plain.schema.fields)) + ", found binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            cells = batch.column(at).to_pylist()
            found = [own.encode(t or "") for t in cells] if how == "encode" else [own.decode(t or b"") for t in cells]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "found"])

    return plain.mapInArrow(run, schema).toDF(*rest, target)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids``: the ids of each whole text, unsigned 32-bit and little-endian; null counts as empty."""
    return _mapped(docs, text, ids, path, pattern, "encode")


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``rows`` with ``decoded``: the bytes that the ids stand for; null counts as empty. An id without a token fails."""
    return _mapped(rows, ids, decoded, path, pattern, "decode")
