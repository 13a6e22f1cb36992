"""Sorting, top-k, pagination and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PAGE_SIZE = 1000
DEFAULT_MAX_ROWS = 10_000


def sort(df: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Multi-key sort; each key is (column, "asc" or "desc"). A range-partitioned sort, not a single task."""
    return df.orderBy(*[F.col(c).desc() if d == "desc" else F.col(c).asc() for c, d in keys])


def top_k(df: DataFrame, keys: Sequence[tuple[str, str]], n: int) -> DataFrame:
    return sort(df, keys).limit(n)


def _size(page_size: int) -> int:
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page size must be between 1 and {MAX_PAGE_SIZE}")
    return page_size


def paginate(df: DataFrame, order: Sequence[str], page: int = 1, page_size: int = 100) -> DataFrame:
    """Page by number. ``order`` must be a total order; without one, pages of separate runs could overlap.

    Deep pages cost a top-k of page * size rows; ``page_after`` costs the same for every page.
    """
    if not order:
        raise ValueError("pagination needs an order")
    page, size = max(page, 1), _size(page_size)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_after(df: DataFrame, order: Sequence[str], cursor: Sequence[object] | None = None, page_size: int = 100) -> DataFrame:
    """Page by key: rows after ``cursor`` (the order values of the last row seen). The bound reaches the scan."""
    if cursor is not None:
        after = F.lit(False)
        for i, column in enumerate(order):
            equal = F.lit(True)
            for prior, value in zip(order[:i], cursor[:i]):
                equal = equal & (F.col(prior) == F.lit(value))
            after = after | (equal & (F.col(column) > F.lit(cursor[i])))
        # implied by the above and simple enough to be pushed down
        df = df.where((F.col(order[0]) >= F.lit(cursor[0])) & after)
    return df.orderBy(*order).limit(_size(page_size))


def page_info(df: DataFrame, page: int = 1, page_size: int = 100) -> DataFrame:
    """Row with total_rows, total_pages, has_more and the cursor of the next page."""
    page, size = max(page, 1), _size(page_size)
    n = F.count(F.lit(1))
    return df.agg(n.alias("total_rows"), F.ceil(n / size).alias("total_pages"), (n > page * size).alias("has_more"),
                  F.when(n > page * size, F.lit(f"page:{page + 1}:size:{size}")).alias("next_cursor"))


def cap_rows(df: DataFrame, roles: Sequence[str] = (), caps: Mapping[str, int] | None = None) -> DataFrame:
    """Row cap of the most generous known role; 10000 for users without one."""
    caps = {"analyst": 100_000, "viewer": 1_000} if caps is None else caps
    known = [caps[r] for r in roles if r in caps]
    return df.limit(max(known) if known else DEFAULT_MAX_ROWS)


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def except_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that ``b`` does not have (set difference)."""
    return a.select(*b.columns).subtract(b)


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` less as many equal rows as ``b`` has (bag difference)."""
    return a.select(*b.columns).exceptAll(b)


def missing_values(required: Column, present: Column) -> Column:
    return F.array_except(required, present)


def deduplicate(df: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """One row per key: the first by ``order`` where given, otherwise any. Duplicates shrink before the shuffle."""
    if order is None:
        return df.dropDuplicates(list(keys))
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__row"))
    return first.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])
