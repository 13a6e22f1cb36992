"""Row and column filters: partition ranges, policy predicates, consent, clearance, geography."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia import policies as P
from custodia.functions.text import lit_array, lit_map


# ---- time ranges ------------------------------------------------------------------------------------------

def partition_range(start: str, end: str | None = None) -> Column:
    """Predicate over the string partition columns year/month/day.

    One day and one month compare partitions only. Across months the exact bound needs the timestamp, but a
    month-level partition predicate is kept beside it so that other months are never listed or read.
    """
    lo = dt.date.fromisoformat(start)
    hi = dt.date.fromisoformat(end) if end else lo
    if hi < lo:
        raise ValueError("range ends before it starts")
    year, month, day = F.col("year"), F.col("month"), F.col("day")
    if lo == hi:
        return (year == f"{lo.year:04d}") & (month == f"{lo.month:02d}") & (day == f"{lo.day:02d}")
    if (lo.year, lo.month) == (hi.year, hi.month):
        return ((year == f"{lo.year:04d}") & (month == f"{lo.month:02d}")
                & day.between(f"{lo.day:02d}", f"{hi.day:02d}"))
    months = F.lit(False)
    for y in range(lo.year, hi.year + 1):
        first = lo.month if y == lo.year else 1
        last = hi.month if y == hi.year else 12
        months = months | ((year == f"{y:04d}") & month.between(f"{first:02d}", f"{last:02d}"))
    stamp = F.col("timestamp")
    return months & (stamp >= lo.isoformat()) & (stamp < (hi + dt.timedelta(days=1)).isoformat())


def partition_filter(df: DataFrame, start: str, end: str | None = None) -> DataFrame:
    return df.where(partition_range(start, end))


# fixed values: days before the reference date covered by a range token
_TOKEN_DAYS = {"today": (0, 0), "yesterday": (1, 1), "last week": (7, 0), "last 7 days": (7, 0),
               "last month": (30, 0), "past month": (30, 0), "last 30 days": (30, 0)}


def relative_range(token: str, as_of: dt.date) -> tuple[str, str]:
    """Inclusive (start, end) of a range token, seen from ``as_of``."""
    first, last = _TOKEN_DAYS[token]
    return ((as_of - dt.timedelta(days=first)).isoformat(), (as_of - dt.timedelta(days=last)).isoformat())


# ---- row filters ------------------------------------------------------------------------------------------

def row_filter(df: DataFrame, predicates: str | Sequence[str]) -> DataFrame:
    """AND of policy predicates."""
    for predicate in [predicates] if isinstance(predicates, str) else predicates:
        df = df.where(F.expr(predicate))
    return df


def row_filter_template(df: DataFrame, column: str, values: Sequence[object] | None) -> DataFrame:
    """``column IN (${user.attribute})`` with the attribute bound as typed literals; no values, no rows."""
    return df.where(F.col(column).isin(list(values)) if values else F.lit(False))


def role_row_filters(df: DataFrame, roles: Sequence[str], table: str,
                     config: Mapping[str, Mapping] = P.RBAC_ROLES) -> DataFrame:
    """Per column of ``table``, rows whose value is allowed by any of the roles. Unknown roles add nothing; without a known one no row is left."""
    if not any(role in config for role in roles):
        return df.where(F.lit(False))
    allowed: dict[str, list] = {}
    for role in roles:
        for key, values in config.get(role, {}).get("row_filters", {}).items():
            owner, _, column = key.rpartition(".")
            if owner == table:
                allowed.setdefault(column, []).extend(values)
    for column, values in allowed.items():
        df = df.where(F.col(column).isin(sorted(set(values))))
    return df


def viewer_region_filter(df: DataFrame, roles: Sequence[str], regions: Sequence[str] = P.VIEWER_REGIONS,
                         column: str = "region", known: Sequence[str] = (*P.RBAC_ROLES, "viewer")) -> DataFrame:
    """Viewers see ``regions``; other known roles see every row, and a user without a known role sees none."""
    if not any(role in known for role in roles):
        return df.where(F.lit(False))
    if "viewer" in roles and "admin" not in roles:
        return df.where(F.col(column).isin(list(regions)))
    return df


def geo_restrict(df: DataFrame, role: str, geo_of: Mapping[str, str], column: str = "region",
                 limits: Mapping[str, Sequence[str]] = P.ROLE_GEO) -> DataFrame:
    """Keep rows whose region maps to a geography the role may see. Unknown roles see nothing."""
    if role not in limits:
        return df.where(F.lit(False))
    if not limits[role]:
        return df
    regions = sorted(r for r, geo in geo_of.items() if geo in limits[role])
    return df.where(F.col(column).isin(regions))


def purpose_filter(df: DataFrame, consents: DataFrame, purpose: str, subject: str = "customer_id",
                   defaults: Mapping[str, bool] = P.CONSENT_DEFAULTS) -> DataFrame:
    """Rows of subjects who consent to ``purpose``; without a record the purpose's default applies.

    A granted default only needs the refusals (anti join), a denied default only the grants (semi join), so the
    smaller consent set is what gets shuffled or broadcast.
    """
    records = consents.where(F.col("purpose") == purpose)
    if defaults.get(purpose, False):
        refused = records.where(~F.coalesce("granted", F.lit(False))).select(subject).distinct()
        return df.join(refused, subject, "left_anti")
    # a subject with both a grant and a refusal on record counts as refused
    refused = records.groupBy(subject).agg(F.bool_and(F.coalesce("granted", F.lit(False))).alias("__ok"))
    return df.join(refused.where("__ok").select(subject), subject, "left_semi")


# ---- request checks ---------------------------------------------------------------------------------------

def role_purpose_check(requests: DataFrame, allowed: Mapping[str, Sequence[str]] = P.ROLE_PURPOSES) -> DataFrame:
    """Adds ``purpose_allowed``: some role of the request (array column ``roles``) permits its purpose."""
    table = lit_map({k: list(v) for k, v in allowed.items()})
    ok = F.exists("roles", lambda r: F.coalesce(F.array_contains(F.element_at(table, r), F.col("purpose")), F.lit(False)))
    return requests.withColumn("purpose_allowed", F.coalesce(ok, F.lit(False)))


def cross_border_check(requests: DataFrame, mechanisms: Mapping[str, str] = P.TRANSFER_MECHANISMS) -> DataFrame:
    """Adds the transfer mechanism of the destination and whether it is allowed; anything unlisted is blocked."""
    mechanism = F.element_at(lit_map(dict(mechanisms)), F.col("destination"))
    return requests.withColumn("mechanism", mechanism).withColumn("transfer_allowed", F.col("mechanism").isNotNull())


def cross_border_filter(requests: DataFrame, mechanisms: Mapping[str, str] = P.TRANSFER_MECHANISMS) -> DataFrame:
    return requests.where(F.col("destination").isin(sorted(mechanisms)))


def _rank(c: Column, levels: Sequence[str]) -> Column:
    return F.array_position(lit_array(levels), c)


def clearance_filter(requests: DataFrame, levels: Sequence[str] = P.CLEARANCES, user_col: str = "clearance",
                     data_col: str = "dataset_clearance") -> DataFrame:
    """Requests whose clearance reaches that of the dataset; unknown levels on either side fail."""
    user, data = _rank(F.col(user_col), levels), _rank(F.col(data_col), levels)
    return requests.where((user > 0) & (data > 0) & (user >= data))


# ---- column filters ---------------------------------------------------------------------------------------

class AccessDenied(ValueError):
    """The request may not run at all."""


def column_deny(df: DataFrame, denied_columns: Iterable[str] = (), table: str | None = None,
                denied_tables: Iterable[str] = ()) -> DataFrame:
    """Drop denied columns; a denied table is refused before anything is planned."""
    if table is not None and table in set(denied_tables):
        raise AccessDenied(f"access to table {table!r} is denied")
    return df.drop(*denied_columns)


def exclude_classifications(df: DataFrame, tags: Mapping[str, Sequence[str]], roles: Sequence[str],
                            permissions: Mapping[str, Mapping] = P.ROLE_PERMISSIONS) -> DataFrame:
    """Drop columns carrying a classification that every role of the user excludes. No known role: refuse."""
    known = [permissions[r] for r in roles if r in permissions]
    if not known:
        raise AccessDenied(f"no known role in {list(roles)}")
    excluded = set.intersection(*[set(p.get("exclude", [])) for p in known])
    return df.drop(*[c for c, t in tags.items() if excluded & set(t)])


# ---- other ------------------------------------------------------------------------------------------------

def dedupe_sources(df: DataFrame, order: str, keys: Sequence[str] = ("provider", "host", "database")) -> DataFrame:
    """First row per (provider, host, database) by arrival. An aggregate, so duplicates shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__row"))
    return first.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def filter_lineage(nodes: DataFrame, domains: Sequence[str] = (), exclude_domains: Sequence[str] = (),
                   tags: Sequence[str] = (), owners: Sequence[str] = ()) -> DataFrame:
    """Include and exclude lists over node tables with columns domain, tags (array) and owner."""
    if domains:
        nodes = nodes.where(F.col("domain").isin(list(domains)))
    if exclude_domains:
        nodes = nodes.where(~F.coalesce(F.col("domain").isin(list(exclude_domains)), F.lit(False)))
    if tags:
        nodes = nodes.where(F.arrays_overlap("tags", lit_array(tags)))
    if owners:
        nodes = nodes.where(F.col("owner").isin(list(owners)))
    return nodes
