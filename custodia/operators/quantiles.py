"""Percentiles: sketch-based by default, exact by distributed rank selection.

Exact ranks need no sorted group. Equal values are counted, the counts are laid out once, range-partitioned by group and
value, and the totals of the partitions say which partition holds a rank. Only those partitions are read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custodia.operators.ordered import join_null_safe
from custodia.session import materialize


def order_statistics(df: DataFrame, group: list[str], col: str, ranks: dict[str, Callable[[Column], Column]], distinct: bool = False) -> DataFrame:
    """Exact values at the requested 0-based ranks: ``ranks`` maps a name to a function of the row count, which is column ``n``.

    Values are in Spark's order, NaN last; nulls do not count. ``distinct`` adds the number of distinct values. The
    counts are written once to the shared folder. A group meets in one task with the totals of its partitions, and
    with the distinct values of those partitions (as many as ranks at most) that hold a wanted rank.
    """
    keys = group or ["__all"]
    counts = df.where(F.col(col).isNotNull()).groupBy(*group, F.col(col).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    if not group:
        counts = counts.withColumn("__all", F.lit(0))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid, _ = materialize(counts.repartitionByRange(parts, *keys, "__v").withColumn("__part", F.spark_partition_id()), "values")
    totals = laid.groupBy(*keys, "__part").agg(F.sum("__n").alias("__pn"), F.count(F.lit(1)).alias("__pd"))
    order, whole = Window.partitionBy(*keys).orderBy("__part"), Window.partitionBy(*keys)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    spots = (totals.withColumn("__lo", F.coalesce(F.sum("__pn").over(before), F.lit(0))).withColumn("n", F.sum("__pn").over(whole))
             .withColumn("distinct", F.sum("__pd").over(whole)))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), fn(F.col("n")).cast("bigint").alias("rank")) for name, fn in ranks.items()])
    spots = spots.withColumn("__want", F.filter(wanted, lambda r: (r["rank"] >= F.col("__lo")) & (r["rank"] < F.col("__lo") + F.col("__pn")))).where(F.size("__want") > 0)
    # the rank of a value is its running count over the partitions read, and what of the group lies in others before it
    spots = spots.withColumn("__skip", F.col("__lo") - F.coalesce(F.sum("__pn").over(before), F.lit(0))).select(*keys, "__part", "n", "distinct", "__want", "__skip")
    spots, _ = materialize(spots, "ranks")
    near = join_null_safe(laid, spots, [*keys, "__part"])
    near = near.withColumn("__top", F.col("__skip") + F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part", "__v").rowsBetween(Window.unboundedPreceding, 0)))
    hit = lambda name: F.exists("__want", lambda r: (r["name"] == name) & (r["rank"] >= F.col("__top") - F.col("__n")) & (r["rank"] < F.col("__top")))
    out = near.groupBy(*keys).agg(F.first("n").alias("n"), *([F.first("distinct").alias("distinct")] if distinct else []),
                                  *[F.max(F.when(hit(name), F.col("__v"))).alias(name) for name in ranks])
    return out if group else out.drop("__all")


def percentiles(df: DataFrame, group: list[str], col: str, ps: dict[str, float], exact: bool = False,
                accuracy: int = 10_000, distinct: bool = False) -> DataFrame:
    """One column per requested percentile; ``exact`` interpolates between neighbouring ranks, and ``distinct`` then adds the number of distinct values."""
    if not exact:
        return df.groupBy(*group).agg(*[
            F.percentile_approx(col, float(p), accuracy).cast("double").alias(name) for name, p in ps.items()])
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in ps.items():
        ranks[f"{name}__lo"] = lambda n, p=p: F.floor((n - 1) * F.lit(float(p)))
        ranks[f"{name}__hi"] = lambda n, p=p: F.ceil((n - 1) * F.lit(float(p)))
    stats = order_statistics(df, group, col, ranks, distinct)
    cols = [F.col("distinct")] if distinct else []
    for name, p in ps.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col(f"{name}__lo").cast("double"), F.col(f"{name}__hi").cast("double")
        # equal neighbours need no interpolation, which would turn infinite ones into NaN
        part = pos - F.floor(pos)
        cols.append(F.when((low == high) | (part == 0), low).otherwise(low + (high - low) * part).alias(name))
    return stats.select(*group, *cols)


def nearest_rank(df: DataFrame, group: list[str], col: str, few: int = 20) -> DataFrame:
    """Summary of a metric with nearest-rank percentiles.

    ``p50`` is the value at rank n/2; ``p95`` and ``p99`` sit at rank floor(n*p), and ``p95`` is the maximum
    while a group has fewer than ``few`` values (the reports' rule; 0 switches it off).
    """
    ranks = {
        "p50": lambda n: F.floor(n / 2),
        "p95": lambda n: F.when(n >= few, F.floor(n * F.lit(0.95))).otherwise(n - 1),
        "p99": lambda n: F.floor(n * F.lit(0.99)),
        "min": lambda n: F.lit(0),
        "max": lambda n: n - 1,
    }
    return order_statistics(df, group, col, ranks).withColumnRenamed("n", "count")
