"""Near-duplicate embeddings by product quantisation.

Equal vectors are counted once, as a class. A class's vector lies in the inverted list of its nearest coarse
centroid, as a residual code per subspace and the length of what the code leaves out. A query visits its
PROBES nearest lists; in each, one table of distances per subspace gives the distance to every code by
look-ups. A code farther than the threshold plus its own quantisation error cannot be a partner, so this
test loses nothing; what passes is compared exactly, in double precision. Recall is a matter of the probes
alone. Lists are cut into tiles of bounded size for queries and members alike, and a tile gives out counts
and a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import connected_components, materialize, ready, spread

THRESHOLD = 0.93
#: Coarse lists, lists visited, subspaces, codes of each, vectors of each dimension that the codebooks are fitted to (by hash).
LISTS, PROBES, SUBSPACES, CODES, SAMPLE = 64, 6, 8, 64, 20_000
#: Queries and members that meet in one tile.
TILE = 2000


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """At most ``k`` centroids of the rows of ``x``."""
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(1) - 2 * x @ centres.T, axis=1)


class Codebooks:
    """Coarse centroids and codes per subspace for unit vectors of one dimension."""

    def __init__(self, sample: np.ndarray, lists: int = LISTS, subspaces: int = SUBSPACES, codes: int = CODES):
        x = unit(sample)
        self.coarse = k_means(x, lists)
        rest = x - self.coarse[nearest(x, self.coarse)]
        self.cuts = np.array_split(np.arange(x.shape[1]), min(subspaces, x.shape[1]))
        self.books = [k_means(rest[:, c], codes) for c in self.cuts]

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the length of what they leave out."""
        codes = np.stack([nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)
        near = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return codes, np.linalg.norm(rest[:, np.concatenate(self.cuts)] - near, axis=1)

    def tables(self, rest: np.ndarray) -> list[np.ndarray]:
        """Squared distances of query residuals to each code of each subspace."""
        return [((rest[:, c][:, None, :] - b[None]) ** 2).sum(2) for c, b in zip(self.cuts, self.books, strict=True)]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled first, so that squares neither overflow nor vanish."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(classes: DataFrame, sample: int = SAMPLE) -> dict[int, Codebooks]:
    """Codebooks by dimension, from at most ``sample`` vectors of each of the 8 commonest dimensions, by hash.

    Vectors of further dimensions share one list per label and dimension; there all are compared.
    """
    dims = [r[0] for r in classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(8).collect()]
    out = {}
    for dim in sorted(dims):
        rows = classes.where(F.col("dim") == dim).select("embedding", F.xxhash64("embedding").alias("h")).orderBy("h", "embedding").limit(sample)
        out[dim] = Codebooks(np.array(rows.toPandas()["embedding"].tolist(), np.float64))
    return out


def _place(books: dict[int, Codebooks], probes: int, kind: str):
    """(cid, label, n, dim, embedding) -> a row per list visited: list, home (the class's own), code, error, probes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            for dim, part in rows.groupby("dim"):
                x = np.array(part["embedding"].tolist(), np.float64)
                if dim in books:
                    book, z = books[dim], unit(x)
                    far = (book.coarse ** 2).sum(1) - 2 * z @ book.coarse.T
                    visits = np.argsort(far, axis=1, kind="stable")[:, :probes]
                    codes, errors = book.encode(z - book.coarse[visits[:, 0]])
                else:
                    visits, codes, errors = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), np.uint8), np.zeros(len(x))
                lists = [v.astype("<i4").tobytes() for v in visits]
                for k in range(visits.shape[1]):
                    yield pa.RecordBatch.from_pandas(pd.DataFrame({
                        "cid": part["cid"].to_numpy(), "label": part["label"].to_numpy(), "n": part["n"].to_numpy(), "dim": dim,
                        "list": visits[:, k], "home": visits[:, 0], "member": k == 0, "vector": [v.astype(kind).tobytes() for v in x],
                        "code": [c.tobytes() for c in codes], "error": errors, "visits": lists}), schema=_PLACED, preserve_index=False)
    return run


_PLACED = pa.schema([("cid", pa.int64()), ("label", pa.string()), ("n", pa.int64()), ("dim", pa.int32()), ("list", pa.int32()), ("home", pa.int32()),
                     ("member", pa.bool_()), ("vector", pa.binary()), ("code", pa.binary()), ("error", pa.float64()), ("visits", pa.binary())])
_PLACED_SQL = "cid long, label string, n long, dim int, list int, home int, member boolean, vector binary, code binary, error double, visits binary"


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the links a-b."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        now = low.copy()
        np.minimum.at(now, a, m)
        np.minimum.at(now, b, m)
        now = now[now]
        if (now == low).all():
            return low
        low = now


def _tile(books: dict[int, Codebooks], threshold: float, kind: str):
    """A tile's links: per class the copies it links to, and its tree edge in the tile's forest."""
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"cid": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
        members, queries = rows[rows["as_member"]], rows[~rows["as_member"]]
        if not len(members) or not len(queries):
            return empty
        dim, at = int(rows["dim"].iloc[0]), int(rows["list"].iloc[0])
        stack = lambda part: np.frombuffer(b"".join(part["vector"]), kind).reshape(len(part), dim)
        q, m = stack(queries), stack(members)
        uq, um = unit(q), unit(m)
        if dim in books:
            book = books[dim]
            codes = np.frombuffer(b"".join(members["code"]), np.uint8).reshape(len(m), -1)
            limit = (reach + members["error"].to_numpy()) ** 2 + 1e-9
        found_q, found_m = [], []
        for start in range(0, len(q), 256):
            part = uq[start:start + 256]
            if dim in books:
                far = sum(t[:, codes[:, i]] for i, t in enumerate(book.tables(part - book.coarse[at])))
                i, j = np.nonzero(far <= limit)
            else:
                i, j = np.divmod(np.arange(len(part) * len(m)), len(m))
            close = np.concatenate([np.einsum("ij,ij->i", part[i[k:k + 65536]], um[j[k:k + 65536]]) >= threshold for k in range(0, len(i), 65536)] or [np.zeros(0, bool)])
            found_q.append(i[close] + start)
            found_m.append(j[close])
        a, b = np.concatenate(found_q), np.concatenate(found_m)
        qid, mid = queries["cid"].to_numpy(), members["cid"].to_numpy()
        home = queries["home"].to_numpy()[a]
        # where both lists show a pair, the list of smaller number counts it; in one list, the smaller id asks
        width = len(members["visits"].iloc[0]) // 4
        visits = np.frombuffer(b"".join(members["visits"]), "<i4").reshape(len(m), width)[b]
        both = (visits == home[:, None]).any(1)
        once = np.where(home == at, qid[a] < mid[b], ~both | (at < home))
        a, b = a[once], b[once]
        if not len(a):
            return empty
        ids, where = np.unique(np.concatenate((qid[a], mid[b])), return_inverse=True)
        left, right = where[:len(a)], where[len(a):]
        links = np.bincount(left, members["n"].to_numpy()[b], len(ids)) + np.bincount(right, queries["n"].to_numpy()[a], len(ids))
        return pd.DataFrame({"cid": ids, "links": links.astype(np.int64), "root": ids[forest(left, right, len(ids))]})
    return run


def links(classes: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES, tile: int = TILE) -> DataFrame:
    """(cid, links, root) rows, several per class: vectors linked in a tile and a node of the same component."""
    spark = ready(classes.sparkSession)
    books = spark.sparkContext.broadcast(fit(classes))  # bounded: 8 dimensions of LISTS centroids and SUBSPACES x CODES codes
    # components as they are stored: floats need half the room of doubles
    kind = "<f4" if classes.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    rows = classes.select("cid", F.col("label").cast("string").alias("label"), "n", "dim", "embedding")
    placed, _ = materialize(rows.mapInArrow(lambda batches: _place(books.value, probes, kind)(batches), _PLACED_SQL), "placed")
    spot = ["label", "dim", "list"]
    sizes = placed.groupBy(*spot).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("nq"), F.ceil(F.sum(F.col("member").cast("int")) / tile).cast("int").alias("nm"))
    sizes, _ = materialize(sizes.where("nm > 0"), "tiles")
    sized = placed.join(sizes, spot).withColumn("salt", F.xxhash64("cid"))
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = sized.withColumn("as_member", F.lit(False)).withColumn("tq", F.pmod("salt", "nq").cast("int")).withColumn("tm", grid("nm"))
    members = sized.where("member").withColumn("as_member", F.lit(True)).withColumn("tm", F.pmod("salt", "nm").cast("int")).withColumn("tq", grid("nq"))
    tiles = queries.unionByName(members).select(*spot, "tq", "tm", "as_member", "cid", "n", "home", "vector", "code", "error", "visits")
    # dealt out by whole tiles: else the tiles of a hot list would stay together, as its rows already are
    return spread(tiles, *spot, "tq", "tm").groupBy(*spot, "tq", "tm").applyInPandas(lambda pdf: _tile(books.value, threshold, kind)(pdf), "cid long, links long, root long")


def groups(vectors: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES, tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors are compared within one label and one dimension. Rows without vec_id or label, and vectors that
    are null, empty or zero or hold a null or non-finite component, link with nothing: they have 0 links and
    are their own component. Equal vectors link with each other. Repeated rows count as vectors of their own.
    """
    ready(vectors.sparkSession)
    rows = vectors.select("vec_id", "embedding", "label")
    fits = F.coalesce(F.expr("vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0 AND "
                             "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"), F.lit(False))
    rows = rows.withColumn("fits", fits).withColumn("h", F.xxhash64("embedding"))
    key = ["label", "h", "embedding"]
    classes = rows.where("fits").groupBy(*key).agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes, _ = materialize(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "classes")
    found, _ = materialize(links(classes, threshold, probes, tile), "links")
    degree = found.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    parts, _ = materialize(parts.select(F.col("node").alias("cid"), "component"), "components")
    known = classes.select(*key, "cid", "first", "n").join(degree, "cid", "left").join(parts, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lowest = known.groupBy("component").agg(F.min("first").alias("component_id"))
    known, _ = materialize(known.join(lowest, "component").select(
        *key, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "classes")
    out = rows.where("fits").join(known, key).select("vec_id", "n_links", "component_id").union(
        rows.where("NOT fits").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
