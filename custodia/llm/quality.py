"""Quality classifier: Bradley-Terry scores learned from preference pairs, cut at a score quantile.

A document's strength is a linear function of text features. For a pair of a good and a bad document the
model says that the good one wins with probability sigmoid(s_good - s_bad); the weights minimise the
logistic loss on feature differences. The cut is the quantile of training scores that separates the labels
best (losing a good document counts thrice), and scores are mapped so that the cut is CUT. Labels, language, source and identifiers are no features.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import ready

#: Labelled documents of each class used for fitting (by hash of doc_id), preference pairs drawn from them, ridge term.
MAX_PER_CLASS, PAIRS, RIDGE = 6000, 60_000, 1e-3
#: The score at the chosen quantile; at or above it a document is accepted.
CUT = 0.3
NAMES = ("upper", "symbol", "pipe", "digit", "punct", "repeat", "unique", "line_repeat", "word_len", "long_word", "short_line", "log_words",
         "lower_start", "top_word", "shout", "marked")


def text_features(text: str) -> tuple[float, ...]:
    """NAMES of one whole text; all zero for an empty one."""
    words = text.split()
    if not words:
        return (0.0,) * len(NAMES)
    n = len(words)
    chars = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = max(1, int(chars[33:].sum()))
    upper, lower = int(chars[65:91].sum()), int(chars[97:123].sum())
    symbols = sum(int(chars[ord(c)]) for c in "#$%&*!<>{}[]^~_\\=@")
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    return (
        upper / max(1, upper + lower), symbols / size, int(chars[124]) / n, int(chars[48:58].sum()) / size,
        sum(int(chars[ord(c)]) for c in ".,;:?'\"()-") / size,
        sum(map(operator.eq, words, words[1:])) / n, len(counts) / n ** 0.9, 1 - len(set(lines)) / max(1, len(lines)),
        float(lengths.mean()) / 10, float((lengths > 20).mean()), sum(len(x) < 20 for x in lines) / max(1, len(lines)),
        float(np.log1p(n)) / 10, sum(x[:1].islower() for x in lines) / max(1, len(lines)), max(counts.values()) / n,
        sum(map(str.isupper, words)) / n, sum(not w[-1].isalnum() and w[-1] not in ".,;:?)'\"-" for w in words) / n)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("__text")
        rows = [text_features(v or "") for v in batch.column(at).to_pylist()]
        found = pa.array(rows, pa.list_(pa.float64()))
        keep = [i for i in range(batch.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [found], [batch.schema.field(i).name for i in keep] + ["__f"])


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of doc_id as text, modulo 5, is 0; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """(quality, __f) of at most ``max_per_class`` labelled documents of each class that are not held out.

    The choice is by hash of doc_id among all labels, so it does not depend on order or partitioning. At
    most twice the bound of ids is joined to the documents; their texts are read in one scan.
    """
    ready(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    known = known.withColumn("__o", F.xxhash64("doc_id"))
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("quality") == label).orderBy("__o", "doc_id").limit(max_per_class)
        chosen = part if chosen is None else chosen.union(part)
    # bounded by 2 * max_per_class rows of two numbers
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).join(F.broadcast(chosen.drop("__o")), "doc_id")
    kind = dict(docs.dtypes)["doc_id"]
    return texts.select("doc_id", F.col("quality").cast("int").alias("quality"), "__text").mapInArrow(
        _featurise, f"doc_id {kind}, quality int, __f array<double>")


class Model:
    """Centre and scale of features, weights, and the line from strength to score."""

    def __init__(self, centre, scale, weights, slope=1.0, cut=0.0):
        self.centre, self.scale, self.weights, self.slope, self.cut = centre, scale, weights, slope, cut

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((np.asarray(x, float) - self.centre) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def bradley_terry(diffs: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> np.ndarray:
    """Weights that minimise mean log(1 + exp(-w.d)) + ridge |w|^2 / 2 over difference rows, by Newton's method."""
    w = np.zeros(diffs.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(diffs @ w, -500, 500)))  # the chance that the worse one wins
        gradient = -(diffs * p[:, None]).mean(0) + ridge * w
        curve = (diffs * (p * (1 - p))[:, None]).T @ diffs / len(diffs) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Model:
    """A model from feature rows and labels; with one label only, a constant model that accepts everything."""
    x, y = np.asarray(x, float), np.asarray(y)
    if len(y) == 0 or len(set(y.tolist())) < 2:
        k = x.shape[1] if x.ndim == 2 else len(NAMES)
        return Model(np.zeros(k), np.ones(k), np.zeros(k))
    centre, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - centre) / scale, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draw = np.random.default_rng(seed)
    w = bradley_terry(z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)])
    model = Model(centre, scale, w)
    s = model.strength(x)
    # the cut: the quantile with the best accuracy, a good one lost counting thrice, in the middle of its plateau
    order = np.quantile(s, np.linspace(0, 1, 1001))
    value = np.array([(3 * (s[good] >= t).mean() + (s[bad] < t).mean()) for t in order])
    model.cut = float(np.median(order[value >= value.max() - 1e-12]))
    # the slope: the one that explains the labels best with the cut in place
    def loss(slope):
        t = slope * (s - model.cut) + np.log(CUT / (1 - CUT))
        return np.mean(np.logaddexp(0, np.where(y == 1, -t, t)))
    model.slope = float(min(np.geomspace(0.05, 20, 60), key=loss))
    return model


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Model:
    """Fit on a bounded labelled sample, whose features (not texts) reach the driver."""
    rows = training_rows(docs, labels, max_per_class).toPandas().sort_values(["doc_id", "quality"])
    return fit(np.array(rows["__f"].tolist(), float).reshape(len(rows), len(NAMES)), rows["quality"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 at CUT or more); null texts count as empty.

    One narrow pass over whole texts; every column stays, except old ones called score or predicted.
    """
    ready(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("score", "predicted", "__score")]
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in rest) + ", __score double"
    centre, scale, weights, slope, cut = model.centre, model.scale, model.weights, model.slope, model.cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Model(centre, scale, weights, slope, cut)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            found = judge.score(np.array([text_features(t or "") for t in texts], float).reshape(len(texts), len(NAMES)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "__score"])

    out = docs.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)
    return out.select(*[F.col(f"`{c}`") for c in rest], F.col("__score").alias("score"), (F.col("__score") >= CUT).cast("int").alias("predicted"))
