"""What the physical plans must and must not contain."""

import datetime as dt

import pytest
from plan_flags import plan_of, red_flags
from pyspark.sql import functions as F

from checks import QUERIES
from checks.fixtures import Tables
from custodia.operators import filters
from custodia.operators import session_reports as sr
from custodia.operators.redaction import redact
from custodia.plans.governed import TablePolicy, User, governed_view
from custodia.sources import sessions as src

# one row per period, already aggregated, is all this window ever sees
SMALL_WINDOW = {"w2_change_from_previous"}
RUNS_A_JOB = ("n", "t12", "s", "t1_request_metrics_stream", "t2_dedupe_requests_stream", "t3_health_transitions_stream", "t5_audit_trail_stream",
              "t6_pii_access_alerts_stream", "t8", "t9", "t10_rate_breaches_stream", "d11")


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(RUNS_A_JOB)])
def test_no_red_flags(name, spark, sf_dir):
    flags = red_flags(QUERIES[name](spark, sf_dir))
    assert not flags or name in SMALL_WINDOW, flags


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sessions") / "data")
    src.write_sessions(Tables(spark, sf_dir).session_logs, path, "parquet")
    return src.read_sessions(spark, path, "parquet")


def test_partition_filters_reach_the_scan(stored):
    for rng in (("2024-01-05", "2024-01-09"), ("2023-12-20", "2024-01-03")):
        scan = plan_of(filters.partition_filter(stored, *rng))
        assert "PartitionFilters: [isnotnull" in scan or "PartitionFilters: [(" in scan or "PartitionFilters: [((" in scan
        assert "year#" in scan.split("PartitionFilters:")[1].split("PushedFilters")[0]


def test_reports_read_only_their_columns(stored):
    plan = plan_of(sr.success_rate_by_language(stored))
    assert "ReadSchema: struct<language:string,success:boolean>" in plan


def test_top_k_does_not_sort_everything(stored):
    assert "TakeOrderedAndProject" in plan_of(sr.top_families(stored))


def test_share_uses_a_scalar_subquery(stored):
    plan = plan_of(sr.breakdown(stored))
    assert "Window" not in plan and "ubquery" in plan


def test_shares_scan_their_source_once(stored):
    # the groups were written while the report was built; nothing after that reads the sessions
    plan = plan_of(sr.breakdown(stored))
    assert "/groups-" in plan and stored.inputFiles()[0].rsplit("/data/", 1)[0] not in plan


def test_masking_is_one_narrow_projection(spark, sf_dir):
    plan = plan_of(redact(Tables(spark, sf_dir).read("customer"), {"c_name": ["PII"]}, ["analyst"]))
    assert "Exchange" not in plan and "Python" not in plan


def test_governed_filter_is_pushed_below_the_mask(stored):
    from custodia.operators.redaction import MaskPolicy
    from custodia.plans.governed import RowRule
    policy = TablePolicy("session_logs", ("analyst",), row_rules=(RowRule(predicate="language = 'en-GB'"),), masks=(MaskPolicy("language", "hash"),))
    plan = plan_of(governed_view(stored, User("u", ["analyst"]), policy))
    assert "EqualTo(language,en-GB)" in plan


def test_dimension_joins_broadcast_by_size_not_by_hint(spark, sf_dir):
    df = QUERIES["a34_monthly_revenue_by_region"](spark, sf_dir)
    df.collect()
    assert "BroadcastHashJoin" in plan_of(df) and "ResolvedHint" not in df._jdf.queryExecution().analyzed().toString()


def test_retention_window_is_pushed_down(spark, sf_dir):
    from custodia.operators.retention import audit_retention
    audit = Tables(spark, sf_dir).events.withColumnRenamed("event_id", "audit_id")
    assert "GreaterThan(ts," in plan_of(audit_retention(audit, "ts", dt.date(2024, 4, 10), 90).select(F.col("audit_id")))
