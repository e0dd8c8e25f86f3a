"""Plan-shape checks: the physical plans keep the properties the operators
are designed for (pushdown, pruning, top-k, partial aggregation, bounded
broadcasts, no raw-row expansion for sliding windows)."""

import re

import __spark_entry__ as E
from helpers import SF_SMALL
from nightjar.operators import slo
from nightjar.plans.views import Domain


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def q(spark, name):
    return plan_of(E.queries()[name](spark, SF_SMALL))


def test_hunting_filters_reach_parquet_and_prune_columns(spark):
    p = q(spark, "f3_hunt_total")
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-15T00:00)" in p
    scan = [line for line in p.splitlines() if "FileScan parquet" in line][0]
    assert "props" not in scan and "value" not in scan  # only needed columns are read


def test_pages_and_timeline_are_top_k(spark):
    for name in ("set1_timeline", "f1_alert_page", "so3_recent_alerts", "f2_hunt_raw_events"):
        p = q(spark, name)
        assert "TakeOrderedAndProject" in p, name
        assert not re.search(r"\bSort \[.*\], true", p), name  # no global sort


def test_asset_risk_aggregates_before_join(spark):
    p = q(spark, "a7_asset_risk")
    assert p.count("partial_count") >= 2 and p.count("partial_sum") >= 2
    # facts reach the joins one row per asset: each join input below is a HashAggregate
    assert re.search(r"LeftOuter", p)


def test_only_bounded_sides_are_broadcast_explicitly(spark):
    # the technique dimension (fixed size) is broadcast; the fact side is not
    p = q(spark, "a4_mitre_frequency")
    assert "BroadcastHashJoin" in p and "partial_count" in p


def test_detection_filter_is_not_duplicated(spark):
    p = q(spark, "det5_ingest_syslog")
    assert "Filter" not in p or "RLIKE" not in "".join(l for l in p.splitlines() if "Filter" in l)
    assert max(len(line) for line in p.splitlines()) < 5000  # no giant inlined predicate


def test_sliding_windows_spread_panes_not_rows(spark):
    d = Domain(spark, SF_SMALL)
    p = plan_of(slo.windowed_quantiles(d.http_requests, "ts", "duration_ms", ["method"]))
    # the explode that copies into 20 windows sits above the pane aggregate
    gen = p.index("Generate explode(")
    pane_agg = p.index("partial_count", gen)
    assert gen < pane_agg
    exact = plan_of(slo.windowed_quantiles(d.http_requests, "ts", "duration_ms", method="exact"))
    assert exact.index("Generate explode(") < exact.index("partial_count", exact.index("Generate explode("))


def test_hot_keys_split_by_bucket_in_sequences(spark):
    p = q(spark, "w3_status_timeline")
    assert "date_trunc" in p.lower() or "_cf_bucket" in p
    assert re.search(r"Window \[.*\], \[entity_id#\d+L?, _cf_bucket", p)


def test_no_cross_joins_in_any_registered_plan(spark):
    """One-row values are scalar subqueries and the grid is one range: no
    CartesianProduct / nested-loop join anywhere."""
    bad = []
    for name, fn in E.queries().items():
        p = plan_of(fn(spark, SF_SMALL))
        if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p:
            bad.append(name)
    assert bad == []
