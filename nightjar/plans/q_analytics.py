"""Registered analytics queries (A-*, J-3..J-7, J-12, W-1, SET-1, SO-3..SO-6)."""

from __future__ import annotations

from nightjar import schemas
from nightjar.operators import analytics as an
from nightjar.plans.oracle_views import _case, with_views
from nightjar.plans.registry import AS_OF, register
from nightjar.plans.views import Domain

SINCE_30 = "TIMESTAMP '2024-01-01 00:00:00'"
SINCE_7 = "TIMESTAMP '2024-01-24 00:00:00'"
SEVS = schemas.SEVERITIES
# Risk points as the oracle states them, apart from the library's own tables.  Fixed values.
ORACLE_VULN_POINTS = {"critical": 25, "high": 15, "medium": 8, "low": 3, "info": 1}
ORACLE_ALERT_POINTS = {"critical": 20, "high": 12, "medium": 6, "low": 2, "info": 1}
ORACLE_MULTIPLIER = {"critical": 1.3, "high": 1.15, "medium": 1.0, "low": 0.85, "info": 0.7}


def _techs_of(alert_id_expr: str) -> str:
    return (f"coalesce((SELECT string_agg(mitre_technique_id, ',' ORDER BY mitre_technique_id) "
            f"FROM alert_mitre_mappings mm WHERE mm.alert_id = {alert_id_expr}), '')")


# -- A-1 ---------------------------------------------------------------------
@register("a1_alerts_trend", with_views(f"""
SELECT strftime(created_at, '%Y-%m-%d') AS date,
       {", ".join(f"CAST(count_if(severity = '{s}') AS BIGINT) AS {s}" for s in SEVS)},
       CAST({" + ".join(f"count_if(severity = '{s}')" for s in SEVS)} AS BIGINT) AS total
FROM alerts WHERE created_at >= {SINCE_30}
GROUP BY 1""", ["alerts"]))
def a1(d: Domain):
    return an.alerts_trend(d.alerts, 30, AS_OF)


# -- A-2 ---------------------------------------------------------------------
HEATMAP_SQL = """
SELECT CAST(extract(dow FROM created_at) AS INTEGER) AS day_of_week,
       CAST(extract(hour FROM created_at) AS INTEGER) AS hour, count(*) AS count
FROM alerts WHERE created_at >= {since} GROUP BY 1, 2"""


@register("a2_alerts_heatmap", with_views(HEATMAP_SQL.format(since=SINCE_30), ["alerts"]))
def a2(d: Domain):
    return an.alerts_heatmap(d.alerts, 30, AS_OF)


# -- J-12 / A-3 --------------------------------------------------------------
GRID_CTES = {
    "h": HEATMAP_SQL.format(since=SINCE_7),
    "g": "SELECT CAST(r.range // 24 AS INTEGER) AS day_of_week, CAST(r.range % 24 AS INTEGER) AS hour "
         "FROM range(168) r",
    "c": "SELECT g.day_of_week, g.hour, CAST(coalesce(h.count, 0) AS BIGINT) AS count "
         "FROM g LEFT JOIN h ON g.day_of_week = h.day_of_week AND g.hour = h.hour",
}


@register("j12_heatmap_grid", with_views("SELECT * FROM c", ["alerts"], GRID_CTES))
def j12(d: Domain):
    return an.heatmap_grid(an.alerts_heatmap(d.alerts, 7, AS_OF))


@register("a3_heatmap_levels", with_views("""
SELECT day_of_week, hour, count, ratio,
       CASE WHEN ratio <= 0 THEN 0 ELSE 1 + least(4, CAST(floor(ratio * 5) AS INTEGER)) END AS level
FROM (SELECT *, count / (SELECT greatest(1, max(count)) FROM c) AS ratio FROM c) r""", ["alerts"], GRID_CTES))
def a3(d: Domain):
    return an.heatmap_levels(an.heatmap_grid(an.alerts_heatmap(d.alerts, 7, AS_OF)))


# -- A-4 / J-4 / SO-5 --------------------------------------------------------
FREQ_SQL = """
SELECT m.mitre_technique_id AS technique_id, coalesce(t.name, m.mitre_technique_id) AS name,
       coalesce(t.tactic, 'unknown') AS tactic, count(*) AS count
FROM alert_mitre_mappings m LEFT JOIN mitre_techniques t ON t.id = m.mitre_technique_id
GROUP BY m.mitre_technique_id, t.name, t.tactic"""


@register("a4_mitre_frequency", with_views(FREQ_SQL, ["alert_mitre_mappings", "mitre_techniques"]))
def a4(d: Domain):
    return an.mitre_frequency(d.alert_mitre_mappings, d.mitre_techniques)


@register("so5_top_techniques", with_views(
    f"SELECT * FROM ({FREQ_SQL}) f ORDER BY count DESC, technique_id LIMIT 10",
    ["alert_mitre_mappings", "mitre_techniques"]))
def so5(d: Domain):
    return an.top_techniques(an.mitre_frequency(d.alert_mitre_mappings, d.mitre_techniques), 10)


@register("j4_technique_lookup", with_views("""
SELECT c.technique_id, coalesce(t.name, c.technique_id) AS name, coalesce(t.tactic, 'unknown') AS tactic, c.count
FROM (SELECT CASE WHEN event_id % 10 = 0 THEN concat('T9', event_id % 7) ELSE concat('T1', event_id % 600) END
             AS technique_id, count(*) AS count FROM events GROUP BY 1) c
LEFT JOIN mitre_techniques t ON t.id = c.technique_id""", ["mitre_techniques"]))
def j4(d: Domain):
    """Lookup with fallback over technique codes of which most are unknown."""
    from pyspark.sql import functions as F
    e = d.table("events")
    code = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("T9"), F.col("event_id") % 7)) \
        .otherwise(F.concat(F.lit("T1"), F.col("event_id") % 600))
    counts = e.groupBy(code.alias("technique_id")).agg(F.count(F.lit(1)).alias("count"))
    return an.technique_lookup(counts, d.mitre_techniques)


# -- J-7 / SO-6 --------------------------------------------------------------
@register("j7_technique_matrix", with_views("""
SELECT o.tactic_position, t.tactic, t.id AS technique_id, t.name, CAST(coalesce(c.n, 0) AS BIGINT) AS alert_count
FROM mitre_techniques t JOIN tactic_order o ON o.tactic = t.tactic
LEFT JOIN (SELECT mitre_technique_id, count(*) AS n FROM alert_mitre_mappings GROUP BY 1) c
       ON c.mitre_technique_id = t.id""", ["mitre_techniques", "tactic_order", "alert_mitre_mappings"]))
def j7(d: Domain):
    return an.technique_matrix(d.mitre_techniques, d.alert_mitre_mappings)


# -- A-5 / J-5 ---------------------------------------------------------------
@register("a5_detection_by_source", with_views("""
SELECT s.id AS source_id, s.name AS source_name, s.type AS source_type,
       CAST(coalesce(r.n, 0) AS BIGINT) AS raw_event_count, CAST(coalesce(a.n, 0) AS BIGINT) AS alert_count,
       CAST(CASE WHEN coalesce(r.n, 0) > 0 THEN round(coalesce(a.n, 0) / coalesce(r.n, 0) * 1000) / 10 ELSE 0 END
            AS DOUBLE) AS alert_rate
FROM ingestion_sources s
LEFT JOIN (SELECT ingestion_source_id, count(*) AS n FROM raw_events GROUP BY 1) r ON r.ingestion_source_id = s.id
LEFT JOIN (SELECT ingestion_source_id, count(*) AS n FROM alerts WHERE ingestion_source_id IS NOT NULL GROUP BY 1) a
       ON a.ingestion_source_id = s.id""", ["ingestion_sources", "raw_events", "alerts"]))
def a5(d: Domain):
    return an.detection_by_source(d.ingestion_sources, d.raw_events, d.alerts)


# -- A-6 / W-1 / J-6 ---------------------------------------------------------
@register("a6_detection_by_rule", with_views(f"""
SELECT g.title, g.severity, {_techs_of('g.sample_alert_id')} AS mitre_technique_ids, g.count, g.sample_alert_id
FROM (SELECT title, severity, count(*) AS count, arg_min(id, created_at) AS sample_alert_id
      FROM alerts WHERE ingestion_source_id IS NOT NULL GROUP BY title, severity) g""",
                                          ["alerts", "alert_mitre_mappings"]))
def a6(d: Domain):
    return an.detection_by_rule(d.alerts, d.alert_mitre_mappings)


@register("w1_rule_samples", with_views("""
SELECT title, severity, count(*) AS count, arg_min(id, created_at) AS sample_alert_id
FROM alerts GROUP BY title, severity""", ["alerts"]))
def w1(d: Domain):
    return an.rule_samples(d.alerts)


# -- J-3 / A-7 / A-8 ---------------------------------------------------------
EXPOSURE_SQL = f"""
SELECT s.id AS asset_id, s.name, s.type, s.criticality,
       CAST(coalesce(v.n, 0) AS BIGINT) AS open_vulnerabilities, CAST(coalesce(v.nc, 0) AS BIGINT) AS critical_vulnerabilities,
       CAST(coalesce(a.n, 0) AS BIGINT) AS open_alerts, CAST(coalesce(a.nc, 0) AS BIGINT) AS critical_alerts,
       CAST(coalesce(v.pts, 0) AS BIGINT) AS vuln_points, CAST(coalesce(a.pts, 0) AS BIGINT) AS alert_points
FROM assets s
LEFT JOIN (SELECT asset_id, count(*) AS n, count_if(severity = 'critical') AS nc,
                  sum({_case('severity', ORACLE_VULN_POINTS, 0)}) AS pts
           FROM vulnerabilities WHERE status = 'open' AND asset_id IS NOT NULL GROUP BY asset_id) v ON v.asset_id = s.id
LEFT JOIN (SELECT asset_id, count(*) AS n, count_if(severity = 'critical') AS nc,
                  sum({_case('severity', ORACLE_ALERT_POINTS, 0)}) AS pts
           FROM alerts WHERE status IN ('open', 'acknowledged') AND asset_id IS NOT NULL GROUP BY asset_id) a
       ON a.asset_id = s.id"""

MULT_SQL = "CASE criticality " + " ".join(
    f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in ORACLE_MULTIPLIER.items()) + \
    " ELSE CAST(1.0 AS DOUBLE) END"


@register("j3_asset_exposure", with_views(EXPOSURE_SQL, ["assets", "vulnerabilities", "alerts"]))
def j3(d: Domain):
    return an.asset_exposure(d.assets, d.vulnerabilities, d.alerts)


@register("a7_asset_risk", with_views(f"""
SELECT asset_id, name, type, criticality, open_vulnerabilities, critical_vulnerabilities, open_alerts,
       critical_alerts, risk_score,
       CASE WHEN risk_score >= 75 THEN 'Critical' WHEN risk_score >= 50 THEN 'High'
            WHEN risk_score >= 25 THEN 'Medium' ELSE 'Low' END AS risk_tier
FROM (SELECT *, CAST(least(100, round(CAST(vuln_points + alert_points AS DOUBLE) * {MULT_SQL})) AS BIGINT) AS risk_score
      FROM ({EXPOSURE_SQL}) e) r""", ["assets", "vulnerabilities", "alerts"]))
def a7(d: Domain):
    return an.asset_risk(d.assets, d.vulnerabilities, d.alerts)


# -- A-9 / A-10 / A-11 -------------------------------------------------------
def summary_sql(alert_where: str = "", incident_where: str = "") -> str:
    """A-9 as scalar subqueries, one per count (no join of one-row tables)."""
    def q(expr: str, table: str, where: str) -> str:
        return f"(SELECT CAST({expr} AS BIGINT) FROM {table} {where})"
    aw, iw = alert_where, incident_where
    cols = [
        (q("count(*)", "alerts", aw), "alerts_total"),
        (q("count_if(status = 'open')", "alerts", aw), "alerts_open"),
        *[(q(f"count_if(severity = '{x}')", "alerts", aw), f"alerts_{x}") for x in ("critical", "high", "medium", "low")],
        (q("count(*)", "incidents", iw), "incidents_total"),
        (q("count_if(status = 'open')", "incidents", iw), "incidents_open"),
        (q("count_if(status = 'investigating')", "incidents", iw), "incidents_investigating"),
        (q("count(*)", "vulnerabilities", ""), "vulnerabilities_total"),
        (q("count_if(status = 'open')", "vulnerabilities", ""), "vulnerabilities_open"),
        (q("count_if(status = 'open' AND severity = 'critical')", "vulnerabilities", ""), "vulnerabilities_critical"),
        (q("count(*)", "assets", ""), "assets_total"),
    ]
    inner = "SELECT " + ", ".join(f"{e} AS {n}" for e, n in cols)
    return f"SELECT *, incidents_open + incidents_investigating AS active_incidents FROM ({inner}) t"


SUMMARY_SQL = summary_sql()


@register("a9_dashboard_summary", with_views(SUMMARY_SQL, ["alerts", "incidents", "vulnerabilities", "assets"]))
def a9(d: Domain):
    return an.dashboard_summary(d.alerts, d.incidents, d.vulnerabilities, d.assets)


@register("a11_severity_share", with_views("""
SELECT alerts_critical / mx * 100 AS share_critical, alerts_high / mx * 100 AS share_high,
       alerts_medium / mx * 100 AS share_medium, alerts_low / mx * 100 AS share_low
FROM (SELECT *, greatest(1, alerts_critical, alerts_high, alerts_medium, alerts_low) AS mx FROM summary) s""",
                                         ["alerts", "incidents", "vulnerabilities", "assets"], {"summary": SUMMARY_SQL}))
def a11(d: Domain):
    return an.severity_share(an.dashboard_summary(d.alerts, d.incidents, d.vulnerabilities, d.assets))


# -- SO-3 / J-1 --------------------------------------------------------------
ALERT_COLS = ("id, title, description, severity, status, source_ip, asset_id, ingestion_source_id, assigned_to_id, "
              "incident_id, created_at, updated_at")


@register("so3_recent_alerts", with_views(f"""
SELECT {ALERT_COLS}, {_techs_of('t.id')} AS mitre_technique_ids
FROM (SELECT * FROM alerts ORDER BY created_at DESC, id DESC LIMIT 5) t""", ["alerts", "alert_mitre_mappings"]))
def so3(d: Domain):
    return an.recent_alerts(d.alerts, d.alert_mitre_mappings, 5)


@register("j1_alerts_with_techniques", with_views(f"""
SELECT {ALERT_COLS}, coalesce(m.ids, '') AS mitre_technique_ids
FROM alerts a LEFT JOIN (SELECT alert_id, string_agg(mitre_technique_id, ',' ORDER BY mitre_technique_id) AS ids
                         FROM alert_mitre_mappings GROUP BY alert_id) m ON m.alert_id = a.id""",
                                                  ["alerts", "alert_mitre_mappings"]))
def j1(d: Domain):
    return an.with_techniques(d.alerts, d.alert_mitre_mappings)


# -- SET-1 / P-3 -------------------------------------------------------------
@register("set1_timeline", with_views(f"""
SELECT id, kind, title, severity, status, occurred_at, mitre_technique_ids FROM (
  SELECT CAST(a.id AS VARCHAR) AS id, 'alert' AS kind, title, severity, status, created_at AS ts,
         strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS occurred_at,
         {_techs_of('a.id')} AS mitre_technique_ids
  FROM alerts a WHERE created_at >= {SINCE_30}
  UNION ALL
  SELECT CAST(id AS VARCHAR), 'incident', title, severity, status, created_at,
         strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z', ''
  FROM incidents WHERE created_at >= {SINCE_30})
ORDER BY ts DESC, kind, id LIMIT 200""", ["alerts", "incidents", "alert_mitre_mappings"]))
def set1(d: Domain):
    return an.timeline(d.alerts, d.incidents, d.alert_mitre_mappings, 30, 200, AS_OF)
