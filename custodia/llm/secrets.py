"""Secrets in texts: patterns, and a battery of randomness tests for what no pattern names.

Patterns (assignments to telling names, access keys, long hex runs) give the base spans. Beside them every run of
key-like characters is a candidate. Its encoding is the smallest alphabet that holds it, and under the hypothesis
"drawn evenly from that alphabet" three tests apply: chi-squared uniformity of the symbols (by its exact moments, as
counts are small), runs above and below the middle of the alphabet, and serial correlation of neighbours. Their
p-values are combined by Fisher's method; a candidate that fails is ordinary. Uniformity is judged by symbols and
by classes (capitals, small letters, digits, marks), as words in a large alphabet are uneven in these first.

A candidate that passes may be ordinary all the same, the likelier the shorter it is. So it also gets an e-value: how
many times likelier it is under even draws than under draws from the characters of the whole corpus. Ordinary
strings reach e with a probability of at most 1 / e, and e grows with each character, so length decides by itself.
Over all m candidates of the corpus the k-th largest counts where e >= m / (k * RATE), which keeps the expected
share of ordinary strings among the spans added at RATE or less, however candidates depend on each other.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from custodia.llm.common import materialize, ready

# What the base spans are, in the order in which ties of position are listed.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32),
}
#: The kind of spans that the tests add.
RANDOM = "random"
KINDS = [*BASE, RANDOM]

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings by their alphabets, smallest first.
ALPHABETS = [
    _DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _LOWER, _UPPER, _UPPER + "234567", _LOWER + "234567",
    _LOWER + _DIGITS, _UPPER + _DIGITS, _UPPER + _LOWER, _UPPER + _LOWER + _DIGITS,
    _UPPER + _LOWER + _DIGITS + "+/", _UPPER + _LOWER + _DIGITS + "-_", _UPPER + _LOWER + _DIGITS + "+/-_",
]
#: Candidates: runs of this length or more. Digits alone are numbers, whose randomness says nothing.
SHORTEST = 16
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}")
#: A candidate is ordinary where even draws give a more uneven one with this probability or less; the rate of false discoveries.
UNEVEN, RATE = 0.001, 0.01
#: e-values are counted by whole powers of two up to this one.
MOST = 200

_CODE = np.full((len(ALPHABETS), 128), -1)
for _i, _letters in enumerate(ALPHABETS):
    _CODE[_i, [ord(c) for c in _letters]] = np.arange(len(_letters))
#: Per encoding the class of each symbol, and the share of each class.
_CLASSES = [np.unique([0 if c in _UPPER else 1 if c in _LOWER else 2 if c in _DIGITS else 3 for c in a], return_inverse=True)[1] for a in ALPHABETS]


def encoding(raw: np.ndarray) -> int:
    """Number of the smallest alphabet that holds all of these ASCII codes."""
    used = np.unique(raw)
    return next(i for i in range(len(ALPHABETS)) if (_CODE[i, used] >= 0).all())


def uniformity(counts: np.ndarray, shares: np.ndarray) -> float:
    """Chi-squared test of counts against shares: a gamma law with the exact mean and variance of the statistic."""
    n, k = int(counts.sum()), len(shares)
    square = float((counts.astype(np.float64) ** 2 / shares).sum()) / n - n
    mean = k - 1
    var = (2 * (k - 1) * (n - 1) + float((1 / shares).sum()) - k * k) / n
    # by the cube root of Wilson and Hilferty
    spread = var / (9 * mean * mean)
    return _above(((max(0.0, square) / mean) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))


def battery(codes: np.ndarray, kind: int) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation of symbols of an encoding under even, independent draws."""
    n, k = len(codes), len(ALPHABETS[kind])
    uniform = uniformity(np.bincount(codes, minlength=k), np.full(k, 1 / k))
    classes = np.bincount(_CLASSES[kind])
    if len(classes) > 1:  # the smaller of two p-values, twice
        uniform = min(1.0, 2 * min(uniform, uniformity(np.bincount(_CLASSES[kind][codes], minlength=len(classes)), classes / k)))
    high = codes >= k / 2
    m = int(high.sum())
    expected = 1 + 2 * m * (n - m) / n
    var = (expected - 1) * (expected - 2) / (n - 1)
    changes = int((high[1:] != high[:-1]).sum()) + 1
    runs = _both((changes - expected) / math.sqrt(var)) if var > 0 else 2.0 ** (1 - n)
    x = codes - codes.mean()
    total = float((x * x).sum())
    # the expected correlation of neighbours is -1 / n, its variance about 1 / n
    serial = _both((float((x[1:] * x[:-1]).sum()) / total + 1 / n) * math.sqrt(n)) if total > 0 else float(k) ** (1 - n)
    return uniform, runs, serial


def _above(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _both(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def combined(p_values: tuple[float, ...]) -> float:
    """Fisher's method: the chance of p-values whose product is as small."""
    half = -sum(math.log(max(p, 1e-300)) for p in p_values)
    return math.exp(-half) * sum(half ** i / math.factorial(i) for i in range(len(p_values)))


def evenness(token: str) -> tuple[int, float]:
    """The encoding of a candidate and its combined p-value under even draws."""
    raw = np.frombuffer(token.encode(), np.uint8)
    kind = encoding(raw)
    return kind, combined(battery(_CODE[kind, raw], kind))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the patterns, in the order of start, then kind."""
    found = []
    for rank, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def candidates(text: str) -> list[tuple[int, str]]:
    """(start, characters) of the runs to be tested; not digits alone."""
    return [(m.start(), m[0]) for m in _CANDIDATE.finditer(text) if not m[0].isdigit()]


def _read(id_type: pa.DataType):
    """Documents -> base spans, even candidates and their number; and per batch the characters of all its texts."""
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    even = pa.list_(pa.struct([("start", pa.int64()), ("encoding", pa.int32()), ("p", pa.float64()), ("token", pa.string())]))
    schema = pa.schema([("doc_id", id_type), ("base", spans), ("even", even), ("tested", pa.int64()), ("letters", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = lru_cache(100_000)(evenness)  # candidates that recur (names, paths) are tested once
        for batch in batches:
            base, passed, tested = [], [], []
            letters = np.zeros(256, np.int64)
            for text in batch.column(1).to_pylist():
                text = text or ""
                letters += np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in base_spans(text)])
                found = [(at, token, *(remembered if len(token) <= 64 else evenness)(token)) for at, token in candidates(text)]
                tested.append(len(found))
                passed.append([{"start": at, "encoding": kind, "p": p, "token": token} for at, token, kind, p in found if p > UNEVEN])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, spans), pa.array(passed, even), pa.array(tested, pa.int64()),
                                              pa.nulls(n, schema.field("letters").type)], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, spans), pa.nulls(1, even), pa.nulls(1, pa.int64()),
                                              pa.array([letters[:128].tolist()], pa.list_(pa.int64()))], schema=schema)
    return run


def surprise(letters: np.ndarray) -> np.ndarray:
    """Per encoding and ASCII code: log2 of how much likelier a character is under even draws than in the corpus.

    Where an alphabet has letters of one case, the corpus' letters of both count: words in capitals are words.
    """
    out = np.zeros(_CODE.shape)
    folded = letters + letters[[ord(chr(c).swapcase()) for c in range(128)]] * [chr(c).isalpha() for c in range(128)]
    for i, alphabet in enumerate(ALPHABETS):
        at = [ord(c) for c in alphabet]
        seen = (letters if "a" in alphabet and "A" in alphabet else folded)[at] + 1.0
        out[i, at] = -np.log2(len(alphabet) * seen / seen.sum())
    return out


def _powers(batches: Iterator[pa.RecordBatch], score: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        token, kind = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        power = [int(min(MOST, max(-1, math.floor(_bits(t, k, score))))) for t, k in zip(token, kind, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(power, pa.int32())], ["power"])


def _bits(token: str, kind: int, score: np.ndarray) -> float:
    """log2 of a candidate's e-value."""
    return float(score[kind, np.frombuffer(token.encode(), np.uint8)].sum())


def threshold(counts: dict[int, int], tested: int, rate: float = RATE) -> int | None:
    """The lowest power of two that counts as a discovery, by numbers of candidates per power; None if none does."""
    at_least, lowest = 0, None
    for power in sorted(counts, reverse=True):
        at_least += counts[power]
        if 2.0 ** power * at_least * rate >= tested:
            lowest = power
    return lowest


def _spans(id_type: pa.DataType, score: np.ndarray, lowest: int | None):
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64()), ("bits", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, even in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows = [(s["start"], KINDS.index(s["kind"]), s["end"], None, None) for s in base]
                for c in even if lowest is not None else ():
                    start, end, bits = c["start"], c["start"] + len(c["token"]), _bits(c["token"], c["encoding"], score)
                    # what lies within a base span is reported by it
                    if math.floor(bits) >= lowest and not any(s["start"] <= start and end <= s["end"] for s in base):
                        rows.append((start, len(BASE), end, c["p"], bits))
                out.append([{"kind": KINDS[k], "start": a, "end": b, "p": p, "bits": bits} for a, k, b, p, bits in sorted(rows, key=lambda r: r[:3])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kinds)], ["doc_id", "spans"])
    return run


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and ``spans``, an array of (kind, start, end, p, bits).

    Spans are in the order of start, then kind; positions are code points, ends exclusive. p and bits (the combined
    p-value and log2 of the e-value) are null for base spans. Null texts count as empty; empty texts have no
    spans; whole texts are read, however long; a row that repeats gets its spans each time; other columns are not
    read; an empty table gives an empty table. Equal e-values are discoveries together or not at all.
    """
    spark = ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    name, id_type = kind.simpleString(), to_arrow_type(kind)
    found, _ = materialize(docs.select("doc_id", "text").mapInArrow(_read(id_type), (
        f"doc_id {name}, base array<struct<kind:string,start:long,end:long>>, "
        "even array<struct<start:long,encoding:int,p:double,token:string>>, tested long, letters array<long>")), "candidates")
    # 128 sums and at most MOST + 2 counts come to the driver, whatever the corpus
    seen = found.where("letters IS NOT NULL").select(F.posexplode("letters").alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n")).collect()
    letters = np.zeros(128)
    for r in seen:
        letters[r["c"]] = r["n"]
    score = surprise(letters)
    rows = found.where("letters IS NULL")
    tested = rows.agg(F.sum("tested")).first()[0] or 0
    powers = rows.select(F.explode("even").alias("c")).select("c.token", "c.encoding").mapInArrow(lambda b: _powers(b, score), "power int")
    lowest = threshold({r["power"]: r["n"] for r in powers.groupBy("power").agg(F.count(F.lit(1)).alias("n")).collect()}, tested, rate)
    return rows.select("doc_id", "base", "even").mapInArrow(
        _spans(id_type, score, lowest), f"doc_id {name}, spans array<struct<kind:string,start:long,end:long,p:double,bits:double>>")
