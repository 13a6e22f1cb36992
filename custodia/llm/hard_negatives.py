"""Hard negatives by anchor-clustered shared lists, exact.

Anchors are clustered by direction. For a cluster with centre c, whose members lie within the angle r of it, no
member u scores a row v higher than |u| |v| cos(max(0, angle(v, c) - r)). The rows are sorted by that bound (without
|u|) once per cluster, and every member walks this list from its top: it keeps its best so far and stops as soon as
the bound of what follows is below the last of them, which certifies the result. A member that is never certified
walks the whole list, so nothing is approximate.

The first walk finds the positives of each anchor, the second the negatives whose scores lie in a window below each
positive's. Rows are dealt into tiles and clusters into groups of bounded size. A cell (a group and a tile) is one
task's work: there each cluster sorts its part of the list, and the best of all cells are merged with a top-k per
anchor. The work is anchors times rows at worst; in many dimensions, where all angles are near 90 degrees, the
bounds certify little.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custodia.llm.common import materialize, ready, spread
from custodia.llm.pq_dedup import k_means, nearest

SCALE = 256
#: Anchors (about) that the centres of one dimension are fitted to, by hash; clusters of a group; the most groups with clusters of their own.
SAMPLE, CLUSTERS, GROUPS = 20_000, 16, 64
#: Numbers (vectors times dimensions) of the rows of a tile and of the anchors of a group.
TILE, GROUP = 1 << 21, 1 << 18
#: Entries of a list, and members, that meet at a time.
STEP, MEMBERS = 4096, 512
#: Least and greatest score.
LONG = -2 ** 63, 2 ** 63 - 1


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and their lengths; zero rows stay."""
    x = x.astype(np.float64)
    n = np.linalg.norm(x, axis=1)
    return x / np.where(n > 0, n, 1)[:, None], n


def shared_list(members: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by their bound for this cluster, and the bounds in that order (per unit of a member's length)."""
    u, n = unit(members)
    v, length = unit(rows)
    centre = u.sum(0)
    size = np.linalg.norm(centre)
    if not size > 0 or not (n > 0).all():
        radius, angle = np.pi, np.zeros(len(rows))
    else:
        centre = centre / size
        radius = np.arccos(np.clip(u @ centre, -1, 1)).max()
        angle = np.arccos(np.clip(v @ centre, -1, 1))
    bound = length * np.cos(np.maximum(0, angle - radius))
    bound += 1e-6 * length + 1e-6  # what rounding may hide
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``score`` (-inf: not there) the places of its k highest, ties by smaller id: (row, column), best first."""
    there = score > -np.inf
    if score.shape[1] > k:
        there &= score >= np.partition(score, -k, axis=1)[:, -k:][:, :1]
    row, col = np.nonzero(there)
    order = np.lexsort((ids[row, col], -score[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], col[rank < k]


def walk(members: np.ndarray, rows: np.ndarray, ids: np.ndarray, fits, k: int, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(member, window, id, score): per member and window the k best rows with low <= score <= high that ``fits`` admits.

    ``fits(members, rows)`` gives a matrix of booleans for numbers of members and rows; ``low`` and ``high`` have
    a row per member and a column per window.
    """
    order, bound = shared_list(members, rows)
    length = unit(members)[1]
    out = []
    for first in range(0, len(members), MEMBERS):
        mine = np.arange(first, min(first + MEMBERS, len(members)))
        windows = low.shape[1]
        # the k best so far of each member and window
        score = np.full((len(mine), windows, k), -np.inf, members.dtype)
        found = np.zeros((len(mine), windows, k), np.int64)
        open_ = np.arange(len(mine))
        for at in range(0, len(order), STEP):
            # certified: the list's next bound is below the last of the best, or below the window
            ahead = (length[mine[open_]] * bound[at])[:, None]
            going = (ahead >= score[open_, :, -1]) & (ahead >= low[mine[open_]])
            open_ = open_[going.any(1)]
            if not len(open_):
                break
            part = order[at:at + STEP]
            now = np.clip(members[mine[open_]] @ rows[part].T, *LONG)
            now[~fits(mine[open_], part)] = -np.inf
            for w in range(windows):
                inside = np.where((now >= low[mine[open_], w][:, None]) & (now <= high[mine[open_], w][:, None]), now, -np.inf)
                both = np.concatenate((score[open_, w], inside), 1)
                names = np.concatenate((found[open_, w], np.broadcast_to(ids[part], inside.shape)), 1)
                i, j = best(both, names, k)
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                kept, kept_ids = np.full((len(open_), k), -np.inf, members.dtype), np.zeros((len(open_), k), np.int64)
                kept[i, rank], kept_ids[i, rank] = both[i, j], names[i, j]
                score[open_, w], found[open_, w] = kept, kept_ids
        for i, w, r in zip(*np.nonzero(score > -np.inf), strict=True):
            out.append((int(mine[i]), int(w), int(found[i, w, r]), int(score[i, w, r])))
    return out


def _stack(part: pd.DataFrame) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in part["q"]])


def _cell(k: int):
    """One cell: the k best rows of its tile for each of its anchors and windows."""
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        out = []
        anchors, rows = cell[cell["aid"] >= 0], cell[cell["aid"] < 0]
        if len(anchors) and len(rows):
            # scores are whole numbers: doubles hold them exactly below 2^53, long doubles below 2^64
            q, r = _stack(anchors), _stack(rows)
            big = float(np.abs(q).max()) * float(np.abs(r).max()) * q.shape[1] >= 2 ** 53
            if big:
                q, r = q.astype(np.longdouble), r.astype(np.longdouble)
            ids, label = rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(object)
            for _, some in anchors.assign(at=np.arange(len(anchors))).groupby("cluster"):
                at = some["at"].to_numpy()
                own, own_label = some["vec_id"].to_numpy(np.int64), some["label"].to_numpy(object)
                low, high = (np.array(some[c].tolist(), np.int64).astype(q.dtype) for c in ("low", "high"))
                same = bool(some["same"].iloc[0])

                def fits(m, n, own=own, own_label=own_label, same=same):
                    return ((own_label[m][:, None] == label[n]) == same) & (own[m][:, None] != ids[n])
                aid = some["aid"].to_numpy(np.int64)
                out += [(aid[m], w, i, max(LONG[0], min(s, LONG[1]))) for m, w, i, s in walk(q[at], r, ids, fits, k, low, high)]
        return pd.DataFrame(out, columns=["aid", "window", "id", "score"]).astype({"aid": "int64", "window": "int32", "id": "int64", "score": "int64"})
    return run


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of all cells per key, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _centres(rows: pd.DataFrame) -> pd.DataFrame:
    x = unit(_stack(rows))[0]
    centres = k_means(x, min(len(x), int(rows["clusters"].iloc[0])))
    return pd.DataFrame({"dim": rows["dim"].iloc[:1], "centres": [centres.ravel().tolist()]})


def _assign(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    if not len(rows) or not len(centres):
        return rows.assign(cluster=0)[["aid", "cluster"]]
    x = unit(_stack(rows))[0]
    return pd.DataFrame({"aid": rows["aid"].to_numpy(), "cluster": nearest(x, np.array(centres["centres"].iloc[0]).reshape(-1, x.shape[1])).astype(np.int32)})


def clusters(anchors: DataFrame) -> DataFrame:
    """(aid, cluster) of anchors (aid, dim, q, n: the anchors of this dimension): the nearest of centres fitted to a sample."""
    wanted = F.least(F.lit(GROUPS), F.ceil(F.col("n") * F.col("dim") / GROUP)) * CLUSTERS
    share = F.xxhash64("q", "aid").bitwiseAND((1 << 30) - 1) < F.least(F.lit(1.0), SAMPLE / F.col("n")) * (1 << 30)
    centres = anchors.where(share).select("dim", "q", wanted.cast("int").alias("clusters")).groupBy("dim").applyInPandas(_centres, "dim int, centres array<double>")
    # anchors of one dimension are assigned in parts of bounded size, each with a copy of the centres
    parts = F.ceil(F.col("n") * F.col("dim") / GROUP).cast("int")
    salted = anchors.select(F.col("dim").alias("of"), F.pmod(F.xxhash64("aid"), parts).cast("int").alias("salt"), "aid", "q")
    each = anchors.groupBy("dim").agg(F.max(parts).alias("parts")).select(F.col("dim").alias("d"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    copies = each.join(centres, F.col("d") == F.col("dim")).select("dim", "salt", "centres")
    return salted.groupBy("of", "salt").cogroup(copies.groupBy("dim", "salt")).applyInPandas(_assign, "aid long, cluster int")


def _cells(anchors: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(aid, window, id, score): the k best per anchor, window and cell.

    ``anchors``: aid, dim, grp, part, cluster, vec_id, label, q, low, high, same. ``rows``: dim, tile, tiles, vec_id, label, q.
    """
    parts = anchors.select("dim", "grp", "part").distinct()
    members = anchors.join(rows.select("dim", "tiles").distinct(), "dim").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    no_anchor = [F.lit(-1).cast("long").alias("aid"), F.lit(-1).alias("cluster"), F.lit(None).cast("array<long>").alias("low"),
                 F.lit(None).cast("array<long>").alias("high"), F.lit(False).alias("same")]
    lists = rows.drop("tiles").join(parts, "dim").select("*", *no_anchor)
    key = ["dim", "grp", "part", "tile"]
    cells = members.unionByName(lists).select(*key, "aid", "cluster", "vec_id", "label", "q", "low", "high", "same")
    return spread(cells, *key).groupBy(*key).applyInPandas(_cell(k), "aid long, window int, id long, score long")


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``vectors`` (vec_id, label, embedding).

    A component x counts as floor(scale * x). An anchor's positives are its ``positives`` highest-scoring other
    rows of the same label, by inner product; for each, the ``negatives`` highest-scoring rows of other labels whose
    score lies between ``low`` and ``high`` per cent of the positive's are its hard negatives. Ties go to the smaller
    vec_id. ``anchor`` marks the anchors, over the columns of ``vectors``.

    Rows without vec_id or label, and vectors that are null, empty or hold null or non-finite components (or ones
    whose product with ``scale`` is not finite) take no part. Vectors of different dimensions never meet. Rows that
    repeat count once; rows of one vec_id are never each other's positives or negatives. Negative positive scores have no
    window, so no rows. Scores beyond a long are cut to its limits. An empty table gives no rows; further columns
    are not read.
    """
    ready(vectors.sparkSession)
    fits = F.coalesce(F.expr(f"vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0 AND "
                             f"forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(double(x) * {scale}) < double('Infinity'))"), F.lit(False))
    # a double of 2^52 or more is whole already, and may be too large for the result of floor
    whole = F.expr(f"transform(transform(embedding, x -> double(x) * {scale}), y -> if(abs(y) < {2 ** 52}, double(floor(y)), y))")
    rows = vectors.withColumn("__anchor", F.coalesce(anchor, F.lit(False))).where(fits).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.size("embedding").alias("dim"), whole.alias("q"), F.col("__anchor").alias("anchor"))
    rows, _ = materialize(rows.distinct().withColumn("aid", F.monotonically_increasing_id()), "rows")
    counts, _ = materialize(rows.groupBy("dim").agg(F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("n")).where("n > 0"), "counts")
    tiles = F.ceil(F.col("rows") * F.col("dim") / TILE).cast("int")
    tiled = rows.join(counts.select("dim", tiles.alias("tiles")), "dim").select(
        "dim", F.pmod(F.xxhash64("vec_id", "q"), "tiles").cast("int").alias("tile"), "tiles", "vec_id", "label", "q")
    tiled, _ = materialize(tiled, "tiles")
    anchors, _ = materialize(rows.where("anchor").join(counts.select("dim", "n"), "dim").drop("anchor"), "anchors")
    placed = anchors.join(clusters(anchors), "aid").withColumn("grp", F.expr(f"cluster div {CLUSTERS}").cast("int"))
    sizes = placed.groupBy("dim", "grp").agg(F.ceil(F.count(F.lit(1)) * F.col("dim") / GROUP).cast("int").alias("parts"))
    placed, _ = materialize(placed.join(sizes, ["dim", "grp"]).withColumn("part", F.pmod(F.xxhash64("aid"), "parts").cast("int")).drop("n", "parts"), "anchors")
    least, most = (F.lit(x).cast("long") for x in LONG)
    near = _cells(placed.select("*", F.array(least).alias("low"), F.array(most).alias("high"), F.lit(True).alias("same")), tiled, positives)
    near, _ = materialize(_top(near, ["aid"], positives).select("aid", F.col("rank").alias("k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # window k - 1 is that of the k-th positive; whole per cents, so that its ends are exact
    ends = near.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("k", "positive_score"))).alias("p"))
    exact = "CAST(x.positive_score AS DECIMAL(20, 0))"
    ends = ends.select("aid", F.expr(f"transform(p, x -> CAST(ceil({exact} * {low} / 100) AS BIGINT))").alias("low"),
                       F.expr(f"transform(p, x -> CAST(floor({exact} * {high} / 100) AS BIGINT))").alias("high"))
    # windows of fewer positives are closed ones
    fill = lambda c, x: F.concat(c, F.array_repeat(x, F.lit(positives) - F.size(c)))
    ends = ends.select("aid", fill("low", most).alias("low"), fill("high", least).alias("high"))
    far = _cells(placed.join(ends, "aid").withColumn("same", F.lit(False)), tiled, negatives)
    far = _top(far, ["aid", "window"], negatives).withColumn("k", F.col("window") + 1)
    return (far.join(near, ["aid", "k"]).join(placed.select("aid", F.col("vec_id").alias("anchor_id")), "aid")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
