"""Retention, erasure and data-subject rights as batch jobs.

Cut-off dates are constants per category, so age tests are plain comparisons that reach the scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia import policies as P
from custodia.functions.text import glob_to_regex, lit_array


def assign_retention(tables: DataFrame, policy: Mapping[str, Mapping] = P.RETENTION) -> DataFrame:
    """Adds ``category``: a hold tag overrides everything, then the first category whose list or pattern matches."""
    name = F.lower("table_name")
    out = F
    for category, scope in policy.items():
        if scope.get("tags"):
            out = out.when(F.arrays_overlap("tags", lit_array(scope["tags"])), category)
    for category, scope in policy.items():
        hit = F.lit(False)
        if scope.get("tables"):
            hit = hit | name.isin(list(scope["tables"]))
        for pattern in scope.get("patterns", []):
            hit = hit | name.rlike(glob_to_regex(pattern))
        if scope.get("tables") or scope.get("patterns"):
            out = out.when(hit, category)
    return tables.withColumn("category", out.otherwise("default"))


def _cutoff(scope: Mapping, step: str, as_of: dt.date) -> Column | None:
    """Rows at or before this instant are due for the step; None when the step never happens."""
    day = F.lit(as_of)
    if scope.get(f"{step}_days") is not None:
        return F.date_sub(day, scope[f"{step}_days"]).cast("timestamp_ntz")
    if scope.get(f"{step}_months") is not None:
        return F.add_months(day, -scope[f"{step}_months"]).cast("timestamp_ntz")
    return None


def lifecycle_action(df: DataFrame, ts_col: str, as_of: dt.date, category: str = "category",
                     policy: Mapping[str, Mapping] = P.RETENTION, out: str = "lifecycle_action") -> DataFrame:
    """keep, archive, anonymize or delete by age. A category under hold is never deleted or anonymised."""
    ts = F.col(ts_col)
    case = F
    for name, scope in policy.items():
        here = F.col(category) == name
        for step in ("delete", "anonymize", "archive"):
            if scope.get("hold") and step != "archive":
                continue
            cutoff = _cutoff(scope, step, as_of)
            if cutoff is not None:
                case = case.when(here & (ts <= cutoff), step)
    return df.withColumn(out, case.otherwise("keep"))


def enforce_retention(df: DataFrame, ts_col: str, as_of: dt.date, pii: Mapping[str, Callable[[Column], Column]],
                      deleted_at: str = "deleted_at", category: str = "category",
                      policy: Mapping[str, Mapping] = P.RETENTION) -> DataFrame:
    """Table as it should be rewritten, with ``lifecycle_action`` telling where each row goes.

    Due rows are soft-deleted first (``deleted_at`` set) and leave for good 90 days later; rows due for
    anonymisation have their personal columns masked. Files are immutable, so the caller writes the result to a new
    path, archive rows to the cold one, and swaps.
    """
    rows = lifecycle_action(df, ts_col, as_of, category, policy)
    purge = F.date_sub(F.lit(as_of), P.SOFT_DELETE_DAYS).cast("timestamp_ntz")
    due = F.col("lifecycle_action") == "delete"
    rows = rows.where(~(due & F.coalesce(F.col(deleted_at) <= purge, F.lit(False))))
    rows = rows.withColumn(deleted_at, F.when(due, F.coalesce(deleted_at, F.lit(as_of).cast("timestamp_ntz"))).otherwise(F.col(deleted_at)))
    hide = F.col("lifecycle_action") == "anonymize"
    return rows.withColumns({c: F.when(hide, fn(F.col(c))).otherwise(F.col(c)) for c, fn in pii.items()})


def split_by_action(rows: DataFrame) -> dict[str, DataFrame]:
    action = F.col("lifecycle_action")
    return {"archive": rows.where(action == "archive").drop("lifecycle_action"),
            "live": rows.where(action != "archive").drop("lifecycle_action")}


def retention_report(df: DataFrame, ts_col: str, as_of: dt.date, size_col: str | None = None, category: str = "category",
                     policy: Mapping[str, Mapping] = P.RETENTION) -> DataFrame:
    """Per category: records, due within 30 days, past retention, bytes to archive and rows under hold."""
    rows = lifecycle_action(df, ts_col, as_of, category, policy)
    soon = lifecycle_action(rows, ts_col, as_of + dt.timedelta(days=P.NOTIFY_DAYS), category, policy, out="__soon")
    held = [n for n, s in policy.items() if s.get("hold")]
    deleted = F.col("lifecycle_action") == "delete"
    size = F.col(size_col) if size_col else F.lit(0)
    return soon.groupBy(category).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if((F.col("__soon") == "delete") & ~deleted).alias("approaching"),
        F.count_if(deleted).alias("past_retention"),
        F.coalesce(F.sum(F.when(F.col("lifecycle_action") == "archive", size)), F.lit(0)).alias("archive_bytes"),
        F.count_if(F.col(category).isin(held)).alias("held_records"))


def retention_alerts(report: DataFrame, over_percent: float = 10.0, pending: int = 1000) -> DataFrame:
    """One row per category and alert raised."""
    share = F.col("past_retention") * 100.0 / F.col("total_records")
    raised = F.array_compact(F.array(F.when(share > over_percent, "over_retention"),
                                     F.when(F.col("past_retention") > pending, "pending_deletions")))
    return report.select("category", "past_retention", F.explode(raised).alias("alert"))


# fixed values: grounds that exempt a subject from erasure
ERASURE_EXCEPTIONS = ["legal_obligation", "public_interest", "archiving_purposes"]


def erase_subjects(df: DataFrame, id_col: str, requests: DataFrame, exceptions: Sequence[str] = ERASURE_EXCEPTIONS) -> DataFrame:
    """Rows left after erasing the requested subjects; a subject with an exception on any request stays."""
    exempt = F.coalesce(F.col("exception").isin(list(exceptions)), F.lit(False))
    ids = requests.groupBy("subject_id").agg(F.bool_or(exempt).alias("__keep")).where(~F.col("__keep"))
    return df.join(ids.select(F.col("subject_id").alias(id_col)), id_col, "left_anti")


def subject_access(tables: Mapping[str, tuple[DataFrame, str]], subjects: DataFrame) -> DataFrame:
    """Everything held about the subjects: (table, subject, record as JSON)."""
    out = None
    ids = subjects.select(F.col(subjects.columns[0]).alias("__id")).distinct()
    for name, (df, key) in tables.items():
        mine = df.join(ids, df[key] == ids["__id"], "left_semi")
        part = mine.select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("subject_id"),
                           F.to_json(F.struct(*df.columns)).alias("record"))
        out = part if out is None else out.unionAll(part)
    return out


def restrict_processing(df: DataFrame, id_col: str, restricted: DataFrame) -> DataFrame:
    ids = restricted.select(F.col(restricted.columns[0]).alias(id_col)).distinct()
    return df.join(ids, id_col, "left_anti")


def audit_retention(audit: DataFrame, ts_col: str, as_of: dt.date, days: int = 365) -> DataFrame:
    """Audit rows young enough to keep: a constant bound that prunes date partitions."""
    return audit.where(F.col(ts_col) > F.date_sub(F.lit(as_of), days).cast("timestamp_ntz"))
