"""Revenue analytics over a transaction fact and its dimensions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.operators.aggregates import agg_column


def in_year(df: DataFrame, date_col: str, year: int) -> DataFrame:
    """``year(d) = y`` written as a range, so that partition and row-group statistics can prune."""
    low, high = dt.datetime(year, 1, 1), dt.datetime(year + 1, 1, 1)
    kind = "timestamp_ntz" if df.schema[date_col].dataType.typeName() == "timestamp_ntz" else "timestamp"
    c = F.col(date_col)
    return df.where((c >= F.lit(str(low)).cast(kind)) & (c < F.lit(str(high)).cast(kind)))


def monthly_revenue(df: DataFrame, year: int, date_col: str = "transaction_date", region_col: str = "region",
                    amount_col: str = "amount") -> DataFrame:
    month = F.date_format(F.date_trunc("month", date_col), "yyyy-MM-dd").alias("month")
    return (in_year(df, date_col, year).groupBy(month, F.col(region_col).alias("region"))
            .agg(F.sum(amount_col).alias("total_revenue")).orderBy("month", "region"))


def top_customers(df: DataFrame, n: int = 10) -> DataFrame:
    out = df.groupBy("customer_id").agg(F.count(F.lit(1)).alias("transaction_count"),
                                        F.sum("amount").alias("total_amount"))
    return out.orderBy(F.desc("total_amount"), "customer_id").limit(n)


def generic_aggregate(df: DataFrame, group_by: list[str] = [], aggs: list[str] = ["COUNT"], year: int | None = None,
                      order: str | None = None, limit: int | None = None) -> DataFrame:
    """SUM, COUNT and AVG templates; without grouping columns the result is one global row."""
    rows = df if year is None else in_year(df, "transaction_date", year)
    specs = []
    if "SUM" in aggs:
        specs.append(agg_column("sum", "amount", "total_amount"))
    if "COUNT" in aggs or not aggs:
        specs.append(agg_column("count", "*", "count"))
    if "AVG" in aggs:
        specs.append(agg_column("avg", "amount", "avg_amount"))
    out = rows.groupBy(*group_by).agg(*specs) if group_by else rows.agg(*specs)
    if order:
        key = "total_amount" if "SUM" in aggs else "count"
        out = out.orderBy(F.col(key).desc() if order.upper() == "DESC" else F.col(key).asc(), *group_by)
    return out if limit is None else out.limit(limit)


def star_join(fact: DataFrame, dims: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Inner equi-joins of a fact with its dimensions, given as (dimension, fact key, dimension key).

    No broadcast hint: Catalyst and AQE broadcast a dimension when its measured size is under the threshold and
    use a skew-split sort-merge join beyond it.
    """
    out = fact
    for dim, fact_key, dim_key in dims:
        out = out.join(dim, fact[fact_key] == dim[dim_key], "inner")
    return out


def monthly_revenue_by_region(revenue: DataFrame, regions: DataFrame, periods: DataFrame, year: int,
                              countries: list[str]) -> DataFrame:
    """Revenue per month and country; amounts are summed per (region, period) before the dimension joins."""
    totals = revenue.groupBy("region_id", "period_id").agg(F.sum("amount").alias("amount"))
    regions = regions.where(F.col("country").isin(countries))
    periods = periods.where(F.col("year") == year)
    joined = (totals.join(regions, totals["region_id"] == regions["id"])
              .join(periods, totals["period_id"] == periods["id"]))
    return (joined.groupBy(regions["name"].alias("region"), periods["month"].alias("month"))
            .agg(F.sum("amount").alias("total_revenue")).orderBy("month", "region"))


def enrich_left(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other, key, "left")
