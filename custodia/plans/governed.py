"""Governed views: permission, column denial, row filters and masks composed into one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.operators import filters
from custodia.operators.redaction import MaskPolicy, apply_policies


@dataclass(frozen=True)
class User:
    id: str
    roles: Sequence[str] = ()
    attributes: Mapping[str, Sequence[object]] = field(default_factory=dict)


@dataclass(frozen=True)
class RowRule:
    """Row filter bound to roles: a predicate, or a column limited to the values of a user attribute."""

    predicate: str | None = None
    column: str | None = None
    attribute: str | None = None
    roles: tuple[str, ...] = ()
    exempt_roles: tuple[str, ...] = ()

    def binds(self, roles: Sequence[str]) -> bool:
        have = set(roles)
        return (not self.roles or bool(have & set(self.roles))) and not have & set(self.exempt_roles)


@dataclass(frozen=True)
class TablePolicy:
    table: str
    readers: tuple[str, ...]
    denied_columns: tuple[str, ...] = ()
    row_rules: tuple[RowRule, ...] = ()
    masks: tuple[MaskPolicy, ...] = ()
    restricted_ids: DataFrame | None = None
    id_column: str | None = None


def governed_view(df: DataFrame, user: User, policy: TablePolicy) -> DataFrame:
    """What ``user`` may see of ``df``.

    Row filters run on raw values and before the masks, so a filter on a masked column still means what it says
    and can be pushed to the scan. No reader role: refused, before any job starts.
    """
    if not set(user.roles) & set(policy.readers):
        raise filters.AccessDenied(f"no role of {user.id} may read {policy.table}")
    for rule in policy.row_rules:
        if not rule.binds(user.roles):
            continue
        if rule.predicate is not None:
            df = filters.row_filter(df, rule.predicate)
        else:
            df = filters.row_filter_template(df, rule.column, user.attributes.get(rule.attribute))
    if policy.restricted_ids is not None:
        df = df.join(policy.restricted_ids.select(policy.id_column).distinct(), policy.id_column, "left_anti")
    df = filters.column_deny(df, policy.denied_columns)
    return apply_policies(df, policy.masks, user.roles)


def audit_row(df: DataFrame, user: User, policy: TablePolicy, at: Column, decision: str = "allow") -> DataFrame:
    """One audit record with the number of rows the view returned, ready for ``write_audit``."""
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        at.alias("timestamp"), F.lit("data_access").alias("event_type"), F.lit(user.id).alias("user_id"),
        F.lit("SELECT").alias("action"), F.lit(policy.table).alias("resource"), F.lit(decision).alias("outcome"),
        F.to_json(F.struct(F.col("n").alias("rows"))).alias("details"))


def session_policy(table: str = "session_logs") -> TablePolicy:
    """Default policy of the session table: viewers see their regions only, raw ids are hashed for everybody."""
    return TablePolicy(
        table, readers=("analyst", "viewer", "engineer", "admin", "compliance_officer"),
        row_rules=(RowRule(column="region", attribute="regions", roles=("viewer", "analyst"), exempt_roles=("admin",)),),
        masks=(MaskPolicy("session_id", "hash"), MaskPolicy("*_id_hash", "hash", exempt_roles=("admin",))))


