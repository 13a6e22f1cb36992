"""Ordered per-key operators that never put one key's whole history into one task.

A plain ``Window.partitionBy(key).orderBy(ts)`` sorts a hot key in a single task. Here each history is cut
into chunks of the order column; the window runs per (key, chunk), one summary row per chunk is scanned per
key, and the carried value is joined back on (key, chunk). Only the summaries of a key ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "__chunk"


def chunk_of(df: DataFrame, order: str, size: float) -> Column:
    """Chunk number of the order column: ``size`` is seconds for timestamps and dates, units for numbers."""
    dtype = df.schema[order].dataType
    c = F.col(order)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        c = F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000)
    elif not isinstance(dtype, T.NumericType):
        raise TypeError(f"cannot cut {order} of type {dtype.simpleString()} into chunks")
    return F.floor(c / F.lit(size))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that treats null keys as equal; the right side's keys are dropped."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def _carry(df: DataFrame, keys: list[str], summary: DataFrame, carried: Column, name: str) -> DataFrame:
    """Scan the chunk summaries per key and join the carried value back to the rows of each chunk."""
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry_in = summary.select(*keys, CHUNK, carried.over(earlier).alias(name))
    return join_null_safe(df, carry_in, [*keys, CHUNK], "left")


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, chunk: Column | None = None) -> DataFrame:
    """``row_number()`` per key over ascending ``order``."""
    base = df if chunk is None else df.withColumn(CHUNK, chunk)
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    sizes = base.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("__n"))
    rows = _carry(base.withColumn("__rn", F.row_number().over(local)), keys, sizes, F.sum("__n"), "__before")
    rows = rows.withColumn(out, (F.col("__rn") + F.coalesce("__before", F.lit(0))).cast("bigint"))
    rows = rows.drop("__rn", "__before")
    return rows if chunk is None else rows.drop(CHUNK)


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
             chunk: Column | None = None) -> DataFrame:
    """``lag(value)`` per key."""
    base = df if chunk is None else df.withColumn(CHUNK, chunk)
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    ends = base.groupBy(*keys, CHUNK).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__end"))
    rows = base.withColumn("__lag", F.lag(value).over(local)).withColumn("__first", F.row_number().over(local) == 1)
    rows = _carry(rows, keys, ends, F.last("__end"), "__in")
    rows = rows.withColumn(out, F.when(F.col("__first"), F.col("__in.v")).otherwise(F.col("__lag")))
    rows = rows.drop("__lag", "__first", "__in")
    return rows if chunk is None else rows.drop(CHUNK)


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
                  chunk: Column | None = None, inclusive: bool = True) -> DataFrame:
    """Last non-null ``value`` at or before each row (strictly before it with ``inclusive=False``)."""
    base = df if chunk is None else df.withColumn(CHUNK, chunk)
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    # max_by skips rows without an ordering value, so a chunk without any value still yields its (null) row
    ends = base.groupBy(*keys, CHUNK).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__end"))
    rows = base.withColumn("__local", F.last(value, ignorenulls=True).over(local))
    rows = _carry(rows, keys, ends, F.last("__end", ignorenulls=True), "__in")
    rows = rows.withColumn(out, F.coalesce("__local", "__in")).drop("__local", "__in")
    return rows if chunk is None else rows.drop(CHUNK)


def run_lengths(df: DataFrame, keys: list[str], order: list[str], flag: str, chunk: Column,
                out: str = "run_length") -> DataFrame:
    """Length so far of the run of equal ``flag`` values each row belongs to (gaps and islands).

    Runs are measured inside each chunk; one summary row per chunk tells how long the run is that enters it.
    """
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    so_far = local.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn(CHUNK, chunk).withColumn("__rn", F.row_number().over(local))
    starts = (F.col("__rn") == 1) | ~F.col(flag).eqNullSafe(F.lag(flag).over(local))
    rows = rows.withColumn("__begin", F.when(starts, F.col("__rn")))
    rows = rows.withColumn("__begin", F.last("__begin", ignorenulls=True).over(so_far))

    at = F.struct(*order)
    ends = rows.groupBy(*keys, CHUNK).agg(
        F.min_by(flag, at).alias("__first"), F.max_by(flag, at).alias("__last"), F.count(F.lit(1)).alias("__n"),
        F.max(F.col("__begin")).alias("__tail_begin"))
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    # a chunk that is one single run and repeats the flag before it prolongs the run entering it
    prolongs = (F.col("__tail_begin") == 1) & F.lag("__last").over(by_chunk).eqNullSafe(F.col("__first")) & (F.row_number().over(by_chunk) > 1)
    ends = ends.withColumn("__island", F.when(prolongs, 0).otherwise(1))
    ends = ends.withColumn("__island", F.sum("__island").over(by_chunk.rowsBetween(Window.unboundedPreceding, 0)))
    tail = F.sum(F.col("__n") - F.col("__tail_begin") + 1).over(
        Window.partitionBy(*keys, "__island").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("__tail", tail)
    entering = ends.select(*keys, CHUNK, F.lag(F.struct(F.col("__last").alias("flag"), F.col("__tail").alias("n"))).over(by_chunk).alias("__in"))

    rows = join_null_safe(rows, entering, [*keys, CHUNK], "left")
    joins = F.col("__in").isNotNull() & (F.col("__begin") == 1) & F.col("__in.flag").eqNullSafe(F.col(flag))
    length = F.col("__rn") - F.col("__begin") + 1 + F.when(joins, F.col("__in.n")).otherwise(0)
    return rows.withColumn(out, length.cast("bigint")).drop("__rn", "__begin", "__in", CHUNK)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, salts: int = 64) -> DataFrame:
    """First ``n`` rows per key under ``order`` (make it total for a repeatable result).

    Two rounds: the first ranks inside (key, salt), so a hot key is spread over ``salts`` tasks and only
    ``n`` rows per salt reach the final ranking.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    inner = Window.partitionBy(*keys, "__salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    short = salted.withColumn("__rn", F.row_number().over(inner)).where(F.col("__rn") <= n).drop("__rn", "__salt")
    return short.withColumn("__rn", F.row_number().over(outer)).where(F.col("__rn") <= n).drop("__rn")


def last_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Most recent ``n`` rows per key."""
    return top_per_key(df, keys, [F.col(c).desc() for c in order], n)


def change_from_previous(df: DataFrame, order: list[str], metric: str, keys: list[str] | None = None,
                         out: str = "change_pct", chunk: Column | None = None) -> DataFrame:
    """Percent change of ``metric`` against the previous row of its key; rows without a positive predecessor get null.

    ``chunk`` cuts a long series (without ``keys``, all rows are one): a column that never falls along ``order``,
    such as the month of a day. Only one row per chunk then meets in a task.
    """
    if chunk is not None:
        rows = previous(df, list(keys or []), order, metric, "previous", chunk)
    else:
        rows = df.withColumn("previous", F.lag(metric).over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)))
    change = (F.col(metric) - F.col("previous")) / F.col("previous") * F.lit(100.0)
    return rows.withColumn(out, F.when(F.col("previous") > 0, change))
