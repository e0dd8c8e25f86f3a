"""A-1..A-11, J-3..J-7, J-12, SET-1 on tiny frames (reference analytics cases)."""

import pytest
from pyspark.sql import functions as F

from helpers import mk, ts
from nightjar.operators import analytics as an
from nightjar.sources.tables import mitre_dimension

AS_OF = ts("2024-03-06 12:30:00")  # a Wednesday


def alert(i, sev="medium", status="open", created="2024-03-06 10:15:00", **kw):
    return dict(id=i, title=kw.pop("title", f"a{i}"), severity=sev, status=status, created_at=created,
                updated_at=created, **kw)


def test_trend_counts_and_total(spark):
    a = mk(spark, "alerts", [alert(1, "critical"), alert(2, "critical"), alert(3, "info", created="2024-03-05 23:00:00"),
                             alert(4, "low", created="2024-02-01 00:00:00")])
    out = [r.asDict() for r in an.alerts_trend(a, 7, AS_OF).collect()]
    assert out == [{"date": "2024-03-05", "critical": 0, "high": 0, "medium": 0, "low": 0, "info": 1, "total": 1},
                   {"date": "2024-03-06", "critical": 2, "high": 0, "medium": 0, "low": 0, "info": 0, "total": 2}]


def test_rolling_window_is_not_midnight_aligned(spark):
    a = mk(spark, "alerts", [alert(1, created="2024-03-05 12:29:59"), alert(2, created="2024-03-05 12:30:00")])
    assert [r.total for r in an.alerts_trend(a, 1, AS_OF).collect()] == [1]


def test_heatmap_sunday_zero_and_levels(spark):
    a = mk(spark, "alerts", [alert(1, created="2024-03-03 05:10:00"), alert(2, created="2024-03-03 05:50:00"),
                             alert(3, created="2024-03-06 10:00:00")])
    h = {(r.day_of_week, r.hour): r["count"] for r in an.alerts_heatmap(a, 7, AS_OF).collect()}
    assert h == {(0, 5): 2, (3, 10): 1}
    cells = an.heatmap_levels(an.heatmap_grid(an.alerts_heatmap(a, 7, AS_OF))).collect()
    assert len(cells) == 168
    lv = {(r.day_of_week, r.hour): (r["count"], r.level) for r in cells}
    assert lv[(0, 5)] == (2, 5) and lv[(3, 10)] == (1, 3) and lv[(1, 1)] == (0, 0)


def test_mitre_frequency_lookup_and_fallback(spark):
    m = spark.createDataFrame([(1, "T1110"), (2, "T1110"), (3, "T9999")], "alert_id long, mitre_technique_id string")
    out = [r.asDict() for r in an.mitre_frequency(m, mitre_dimension(spark)).collect()]
    assert out[0] == {"technique_id": "T1110", "name": "Brute Force", "tactic": "Credential Access", "count": 2}
    assert out[1] == {"technique_id": "T9999", "name": "T9999", "tactic": "unknown", "count": 1}
    empty = m.limit(0)
    assert an.mitre_frequency(empty, mitre_dimension(spark)).count() == 0


def test_detection_by_source_rate(spark):
    src = spark.createDataFrame([(1, "s1", "syslog"), (2, "idle", "webhook")], "id long, name string, type string")
    raw = spark.createDataFrame([(1, 1), (2, 1)], "id long, ingestion_source_id long")
    al = mk(spark, "alerts", [alert(1, ingestion_source_id=1), alert(2, ingestion_source_id=2),
                              alert(3, ingestion_source_id=None)])
    out = {r.source_id: (r.raw_event_count, r.alert_count, r.alert_rate)
           for r in an.detection_by_source(src, raw, al).collect()}
    assert out == {1: (2, 1, 50.0), 2: (0, 1, 0.0)}  # 0 when no raw events even with alerts


def test_detection_by_rule_sample(spark):
    al = mk(spark, "alerts", [alert(1, title="Failed authentication attempt detected", ingestion_source_id=1),
                              alert(2, title="Failed authentication attempt detected", ingestion_source_id=1,
                                    created="2024-03-06 11:00:00"),
                              alert(3, title="manual", ingestion_source_id=None)])
    m = spark.createDataFrame([(1, "T1110"), (2, "T1078")], "alert_id long, mitre_technique_id string")
    out = an.detection_by_rule(al, m).collect()
    assert len(out) == 1 and out[0]["count"] == 2 and out[0].mitre_technique_ids == ["T1110"]


def risk(spark, assets, vulns, alerts):
    return {r.name: r.risk_score for r in an.asset_risk(
        mk(spark, "assets", assets), mk(spark, "vulnerabilities", vulns), mk(spark, "alerts", alerts)).collect()}


def test_asset_risk_reference_case(spark):
    assets = [dict(id=1, name="crit", type="server", criticality="critical", created_at="2024-01-01 00:00:00"),
              dict(id=2, name="clean", type="server", criticality="critical", created_at="2024-01-01 00:00:00")]
    vulns = [dict(id="v1", title="t", severity="critical", status="open", asset_id=1,
                  discovered_at="2024-01-01 00:00:00", created_at="2024-01-01 00:00:00"),
             dict(id="v2", title="t", severity="critical", status="remediated", asset_id=1,
                  discovered_at="2024-01-01 00:00:00", created_at="2024-01-01 00:00:00")]
    alerts = [alert(1, "critical", asset_id=1), alert(2, "critical", status="resolved", asset_id=1)]
    assert risk(spark, assets, vulns, alerts) == {"crit": 59, "clean": 0}


@pytest.mark.parametrize("points,crit,expected", [(50, "high", 57), (45, "critical", 59), (200, "medium", 100),
                                                  (10, "info", 7), (30, "low", 26)])
def test_risk_rounding_half_up_on_doubles(spark, points, crit, expected):
    df = spark.createDataFrame([(points, crit)], "p long, c string")
    assert df.select(an.risk_score(F.col("p"), F.col("c")).alias("s")).first().s == expected


def test_asset_risk_demo_golden(spark):
    # demo seed rows, scores computed by hand with the formula
    A = [("web-prod-01", "high"), ("db-prod-01", "critical"), ("DESKTOP-JDOE", "low"), ("vpn-gateway", "high"),
         ("s3-backup-bucket", "medium"), ("CEO-Laptop", "high")]
    assets = [dict(id=i, name=n, type="server", criticality=c, created_at="2024-01-01 00:00:00")
              for i, (n, c) in enumerate(A)]
    V = [(0, "critical"), (3, "critical"), (5, "high")]
    vulns = [dict(id=f"v{k}", title="t", severity=s, status="open", asset_id=a, discovered_at="2024-01-01 00:00:00",
                  created_at="2024-01-01 00:00:00") for k, (a, s) in enumerate(V)]
    L = [(0, "critical"), (1, "critical"), (2, "critical"), (2, "high"), (3, "high"), (5, "medium")]
    alerts = [alert(k, s, asset_id=a) for k, (a, s) in enumerate(L)]
    assert risk(spark, assets, vulns, alerts) == {"web-prod-01": 52, "db-prod-01": 26, "DESKTOP-JDOE": 27,
                                                  "vpn-gateway": 43, "s3-backup-bucket": 0, "CEO-Laptop": 24}


def test_risk_tier(spark):
    df = spark.createDataFrame([(s,) for s in (0, 24, 25, 49, 50, 74, 75, 100)], "s long")
    assert [r.t for r in df.select(an.risk_tier("s").alias("t")).collect()] == [
        "Low", "Low", "Medium", "Medium", "High", "High", "Critical", "Critical"]


def test_summary_and_share_empty_inputs(spark):
    e = lambda n: mk(spark, n, [])
    s = an.dashboard_summary(e("alerts"), e("incidents"), e("vulnerabilities"), e("assets")).first()
    assert s.alerts_total == 0 and s.assets_total == 0 and s.active_incidents == 0
    sh = an.severity_share(an.dashboard_summary(e("alerts"), e("incidents"), e("vulnerabilities"),
                                                e("assets"))).first()
    assert sh.share_critical == 0.0


def test_summary_counts(spark):
    a = mk(spark, "alerts", [alert(1, "critical"), alert(2, "info", status="resolved"), alert(3, "high")])
    i = mk(spark, "incidents", [dict(id=1, title="x", severity="high", status="open", created_at="2024-01-01 00:00:00"),
                                dict(id=2, title="y", severity="high", status="investigating",
                                     created_at="2024-01-01 00:00:00")])
    s = an.dashboard_summary(a, i, mk(spark, "vulnerabilities", []), mk(spark, "assets", [])).first()
    assert (s.alerts_total, s.alerts_open, s.alerts_critical, s.alerts_high, s.active_incidents) == (3, 2, 1, 1, 2)
    sh = an.severity_share(an.dashboard_summary(a, i, mk(spark, "vulnerabilities", []),
                                                mk(spark, "assets", []))).first()
    assert sh.share_critical == 100.0 and sh.share_low == 0.0


def test_timeline_merge_and_ties(spark):
    a = mk(spark, "alerts", [alert(1, created="2024-03-06 10:00:00"), alert(2, created="2024-03-06 11:00:00")])
    i = mk(spark, "incidents", [dict(id=9, title="inc", severity="high", status="open",
                                     created_at="2024-03-06 11:00:00", updated_at="2024-03-06 11:00:00")])
    m = spark.createDataFrame([(2, "T1110")], "alert_id long, mitre_technique_id string")
    out = an.timeline(a, i, m, 1, 2, AS_OF).collect()
    assert [(r.kind, r.id) for r in out] == [("alert", "2"), ("incident", "9")]
    assert out[0].mitre_technique_ids == ["T1110"] and out[1].mitre_technique_ids == []
    assert out[0].occurred_at == "2024-03-06T11:00:00.000Z"


def test_technique_matrix_order_and_zero(spark):
    m = spark.createDataFrame([(1, "T1486")], "alert_id long, mitre_technique_id string")
    rows = an.technique_matrix(mitre_dimension(spark), m).collect()
    assert rows[0].tactic == "Initial Access" and rows[-1].tactic == "Impact"
    assert {r.technique_id: r.alert_count for r in rows}["T1486"] == 1
    assert sum(r.alert_count for r in rows) == 1 and len(rows) == 33


def test_recent_alerts_top5(spark):
    a = mk(spark, "alerts", [alert(k, created=f"2024-03-0{k} 00:00:00") for k in range(1, 8)])
    m = spark.createDataFrame([(7, "T1110")], "alert_id long, mitre_technique_id string")
    out = an.recent_alerts(a, m, 5).collect()
    assert [r.id for r in out] == [7, 6, 5, 4, 3] and out[0].mitre_technique_ids == ["T1110"]


def test_parameter_bounds(spark):
    a = mk(spark, "alerts", [])
    with pytest.raises(ValueError):
        an.alerts_trend(a, 0, AS_OF)
    with pytest.raises(ValueError):
        an.alerts_trend(a, 181, AS_OF)


def test_analytics_job_writes_every_output(spark, scratch):
    import os

    from nightjar.plans.jobs import analytics_job
    from nightjar.plans.views import Domain
    d = Domain(spark, "/root/testdata/sf0.001")
    wh = os.path.join(scratch, "wh")
    for name in ("alerts", "alert_mitre_mappings", "incidents", "vulnerabilities", "assets", "raw_events",
                 "ingestion_sources"):
        getattr(d, name).write.parquet(os.path.join(wh, name))
    paths = analytics_job(spark, wh, os.path.join(scratch, "out"), "2024-01-31 00:00:00")
    assert set(paths) >= {"asset_risk", "alerts_trend", "timeline"}
    assert spark.read.parquet(paths["asset_risk"]).count() == 150
    assert spark.read.parquet(paths["dashboard_summary"]).count() == 1
