"""Generic aggregation surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.functions.numbers import count_true, pct
from custodia.operators.ordered import join_null_safe, top_per_key
from custodia.session import materialize

_AGGS = {
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max,
    "count": lambda c: F.count(F.lit(1) if c == "*" else c),
    "count_distinct": F.count_distinct,
}


def agg_column(fn: str, col: str, alias: str) -> Column:
    if fn not in _AGGS:
        raise ValueError(f"unknown aggregate {fn!r}")
    return _AGGS[fn](col).alias(alias)


def basic_aggs(df: DataFrame, group: list[str], specs: dict[str, tuple[str, str]]) -> DataFrame:
    """``specs`` maps an output name to (function, column)."""
    return df.groupBy(*group).agg(*[agg_column(fn, col, name) for name, (fn, col) in specs.items()])


def distinct_counts(df: DataFrame, group: list[str], cols: dict[str, str], approx: bool = False) -> DataFrame:
    """Distinct values per column. Exact counting shuffles one row per distinct (group, value) and column;
    ``approx`` keeps one sketch per group instead."""
    fn = F.approx_count_distinct if approx else F.count_distinct
    return df.groupBy(*group).agg(*[fn(c).alias(name) for name, c in cols.items()])


def conditional_count(df: DataFrame, group: list[str], conds: dict[str, Column]) -> DataFrame:
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("total"),
                                  *[count_true(cond).alias(name) for name, cond in conds.items()])


def argmax(df: DataFrame, key: str, metric: str) -> DataFrame:
    """The key with the largest metric; the smallest key wins a tie."""
    best = df.where(F.col(metric).isNotNull()).agg(
        F.min_by(F.struct(key, metric), F.struct(-F.col(metric), F.col(key))).alias("best"))
    return best.select(F.col(f"best.{key}").alias(key), F.col(f"best.{metric}").alias(metric))


def rollup_totals(df: DataFrame, levels: list[str], aggs: list[Column]) -> DataFrame:
    return df.rollup(*levels).agg(F.grouping_id().alias("level_id"), *aggs)


def sample_set(df: DataFrame, group: list[str], col: str, cap: int = 10) -> DataFrame:
    """Sorted sample of at most ``cap`` distinct values per group plus the exact distinct count."""
    distinct = df.where(F.col(col).isNotNull()).select(*group, col).distinct()
    few = top_per_key(distinct, group, [F.col(col)], cap)
    samples = few.groupBy(*group).agg(F.sort_array(F.collect_list(col)).alias("samples"))
    sizes = distinct.groupBy(*group).agg(F.count(F.lit(1)).alias("cardinality"))
    return join_null_safe(sizes, samples, group)


def with_share(grouped: DataFrame, count: str, out: str = "percentage", digits: int = 1) -> DataFrame:
    """``grouped`` with each row's share of the sum of ``count``.

    The groups are written to the shared folder first, so the source is scanned (and, for JSON, parsed) once
    at any size; the total is then a scalar subquery over the groups, which never meet in one task.
    """
    groups, _ = materialize(grouped, "groups")
    return groups.withColumn(out, pct(F.col(count), groups.agg(F.sum(count)).scalar(), digits))


def share_of_total(df: DataFrame, dims: list[str], out: str = "percentage", digits: int = 1,
                   count_name: str = "sessions") -> DataFrame:
    """Row count per group and its share of all rows, from one scan."""
    return with_share(df.groupBy(*dims).agg(F.count(F.lit(1)).alias(count_name)), count_name, out, digits)
