"""Registered listing / hunting queries (P-*, F-*, SO-1/2/7, J-1, J-2, J-10, A-12, A-13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar import schemas
from nightjar.operators import listing as ls
from nightjar.operators.analytics import with_techniques
from nightjar.plans.oracle_views import _case, with_views
from nightjar.plans.q_analytics import ALERT_COLS, _techs_of
from nightjar.plans.registry import AS_OF, register
from nightjar.plans.views import Domain

SEV_RANK = _case("severity", {s: i for i, s in enumerate(schemas.SEVERITIES)}, None)
CRIT_RANK = _case("criticality", {s: i for i, s in enumerate(schemas.SEVERITIES)}, None)


@register("p1_public_users", with_views(
    "SELECT id, email, name, role, is_active, created_at FROM users", ["users"]))
def p1(d: Domain):
    return ls.public_users(d.users)


@register("p4_audit_view", with_views("""
SELECT a.id, a.action, coalesce(u.email, 'system') AS actor,
       CASE WHEN a.target_type IS NOT NULL THEN concat(a.target_type, ':', coalesce(substr(a.target_id, 1, 8), ''))
            ELSE '—' END AS target,
       coalesce(a.ip_address, '—') AS ip_address, a.created_at
FROM audit_logs a LEFT JOIN users u ON u.id = a.actor_id""", ["audit_logs", "users"]))
def p4(d: Domain):
    return ls.audit_view(d.audit_logs, d.users)


@register("f1_alert_page", with_views(f"""
SELECT {ALERT_COLS}, {_techs_of('a.id')} AS mitre_technique_ids
FROM (SELECT * FROM alerts WHERE status = 'open' AND severity = 'high'
      ORDER BY created_at DESC NULLS FIRST, id LIMIT 25 OFFSET 25) a""", ["alerts", "alert_mitre_mappings"]))
def f1(d: Domain):
    """F-1 + SO-1 + J-1: second page of open high alerts, newest first."""
    return ls.list_alerts(d.alerts, d.alert_mitre_mappings, status="open", severity="high", asset_id=None,
                          page_no=2, page_size=25)["items"]


@register("so1_alerts_by_severity", with_views(f"""
SELECT {ALERT_COLS} FROM alerts ORDER BY {SEV_RANK} DESC NULLS FIRST, id LIMIT 100 OFFSET 200""", ["alerts"]))
def so1a(d: Domain):
    """SO-1 + SO-4: severity desc means declaration rank desc (info first)."""
    return ls.page(d.alerts, 3, 100, "severity", "desc", "alerts")


@register("so1_assets_by_criticality", with_views(f"""
SELECT id, name, type, criticality, created_at FROM assets ORDER BY {CRIT_RANK} ASC NULLS LAST, id LIMIT 50""",
                                                  ["assets"]))
def so1b(d: Domain):
    return ls.page(d.assets.select("id", "name", "type", "criticality", "created_at"), 1, 50, "criticality", "asc",
                   "assets")


@register("so1_raw_events_keyset", with_views("""
SELECT * FROM raw_events
WHERE received_at < TIMESTAMP '2024-01-20 00:00:00' OR (received_at = TIMESTAMP '2024-01-20 00:00:00' AND id > 0)
ORDER BY received_at DESC, id LIMIT 500""", ["raw_events"]))
def so1c(d: Domain):
    """SO-1 keyset form: the 500 raw events after a (received_at, id) cursor."""
    import datetime as dt
    return ls.keyset_page(d.raw_events, 500, "received_at", (dt.datetime(2024, 1, 20), 0))


@register("a12_alert_total", with_views(
    "SELECT count(*) AS total FROM alerts WHERE status = 'open' AND severity = 'high'", ["alerts"]))
def a12(d: Domain):
    return ls.filtered_total(ls.equality_filters(d.alerts, {"status": "open", "severity": "high"}))


@register("so2_page_bounds", with_views("""
SELECT total, CAST(greatest(1, ceil(total / 25)) AS BIGINT) AS total_pages,
       CAST(CASE WHEN total = 0 THEN 0 ELSE 51 END AS BIGINT) AS start, CAST(least(75, total) AS BIGINT) AS "end"
FROM (SELECT count(*) AS total FROM alerts WHERE status = 'open' AND severity = 'high') t""", ["alerts"]))
def so2(d: Domain):
    tot = ls.filtered_total(ls.equality_filters(d.alerts, {"status": "open", "severity": "high"}))
    return ls.page_bounds(tot, 3, 25)


HUNT_WHERE = ("ingestion_source_id = 2 AND contains(source_ip, '10.0.1') "
              "AND received_at >= TIMESTAMP '2024-01-15 00:00:00'")


@register("f2_hunt_raw_events", with_views(f"""
SELECT * FROM raw_events WHERE {HUNT_WHERE} ORDER BY received_at DESC, id LIMIT 500""", ["raw_events"]))
def f2(d: Domain):
    """F-1 + F-2 + F-3: source, ip substring and since, newest 500."""
    return ls.hunt_raw_events(d.raw_events, ingestion_source_id=2, source_ip="10.0.1", since="2024-01-15 00:00:00",
                              page_no=1, page_size=500)["items"]


@register("f3_hunt_total", with_views(f"SELECT count(*) AS total FROM raw_events WHERE {HUNT_WHERE}",
                                      ["raw_events"]))
def f3(d: Domain):
    return ls.hunt_raw_events(d.raw_events, ingestion_source_id=2, source_ip="10.0.1",
                              since="2024-01-15 00:00:00")["total"]


@register("f8_alert_lookup", with_views(f"""
SELECT {ALERT_COLS}, {_techs_of('a.id')} AS mitre_technique_ids FROM alerts a WHERE id = 4242""",
                                        ["alerts", "alert_mitre_mappings"]))
def f8(d: Domain):
    return with_techniques(ls.lookup(d.alerts, 4242), d.alert_mitre_mappings, small_alerts=True)


@register("f9_user_notifications", with_views("""
SELECT * FROM notifications WHERE user_id = 7 ORDER BY created_at DESC, id LIMIT 25""", ["notifications"]))
def f9(d: Domain):
    return ls.list_notifications(d.notifications, 7, page_no=1, page_size=25)["items"]


@register("f6_unread_page", with_views("""
SELECT * FROM notifications WHERE user_id = 7 AND read_at IS NULL ORDER BY created_at DESC, id LIMIT 25 OFFSET 25""",
                                       ["notifications"]))
def f6(d: Domain):
    return ls.list_notifications(d.notifications, 7, unread_only=True, page_no=2, page_size=25)["items"]


@register("a13_unread_counts", with_views("""
SELECT user_id, CAST(count_if(read_at IS NULL) AS BIGINT) AS unread, count(*) AS total FROM notifications
GROUP BY user_id""",
                                          ["notifications"]))
def a13(d: Domain):
    return ls.unread_count(d.notifications)


@register("f12_retain_raw_events", with_views("""
SELECT id, ingestion_source_id, received_at FROM raw_events
WHERE received_at >= TIMESTAMP '2024-01-24 00:00:00'""", ["raw_events"]))
def f12(d: Domain):
    return ls.retain(d.raw_events, "received_at", AS_OF, 168).select("id", "ingestion_source_id", "received_at")


@register("j2_incident_overview", with_views("""
SELECT i.id AS incident_id, i.title, i.severity, i.status, i.created_at,
       CAST(coalesce(a.n, 0) AS BIGINT) AS alert_count, CAST(coalesce(a.nc, 0) AS BIGINT) AS critical_alert_count,
       a.last_alert_at, CAST(coalesce(t.n, 0) AS BIGINT) AS timeline_count, t.first_entry, t.last_entry
FROM incidents i
LEFT JOIN (SELECT incident_id, count(*) AS n, count_if(severity = 'critical') AS nc, max(created_at) AS last_alert_at
           FROM alerts WHERE incident_id IS NOT NULL GROUP BY incident_id) a ON a.incident_id = i.id
LEFT JOIN (SELECT incident_id, count(*) AS n, arg_min(message, (created_at, id)) AS first_entry,
                  arg_max(message, (created_at, id)) AS last_entry
           FROM incident_timeline_events GROUP BY incident_id) t ON t.incident_id = i.id""",
                                             ["incidents", "alerts", "incident_timeline_events"]))
def j2(d: Domain):
    return ls.incident_overview(d.incidents, d.alerts, d.incident_timeline_events)


@register("j2_incident_alerts", with_views(f"""
SELECT {ALERT_COLS} FROM alerts WHERE incident_id = 4250""", ["alerts"]))
def j2a(d: Domain):
    return ls.incident_detail(d.incidents, d.alerts, d.incident_timeline_events, 4250)["alerts"]


@register("j2_incident_timeline", with_views("""
SELECT * FROM incident_timeline_events WHERE incident_id = 4250""", ["incident_timeline_events"]))
def j2t(d: Domain):
    return ls.incident_detail(d.incidents, d.alerts, d.incident_timeline_events, 4250)["timeline"]


@register("j10_alert_assignees", with_views("""
SELECT a.id, a.assigned_to_id, coalesce(u.email, 'Unassigned') AS assignee
FROM alerts a LEFT JOIN users u ON u.id = a.assigned_to_id""", ["alerts", "users"]))
def j10a(d: Domain):
    return ls.with_assignee(d.alerts, d.users).select("id", "assigned_to_id", "assignee")


@register("j10_vulnerability_assets", with_views("""
SELECT v.id, v.asset_id, coalesce(s.name, '—') AS asset_name
FROM vulnerabilities v LEFT JOIN assets s ON s.id = v.asset_id""", ["vulnerabilities", "assets"]))
def j10v(d: Domain):
    return ls.with_asset_name(d.vulnerabilities, d.assets).select("id", "asset_id", "asset_name")


@register("f5_unresolved_by_severity", with_views("""
SELECT severity, count(*) AS n FROM alerts WHERE status IN ('open', 'acknowledged') GROUP BY severity""",
                                                  ["alerts"]))
def f5(d: Domain):
    return ls.unresolved_alerts(d.alerts).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


# -- F-7 / SO-7 / SC-16 ----------------------------------------------------------------
@register("f7_techniques_by_tactic", with_views("""
SELECT t.id, t.name, t.tactic, count(m.alert_id) AS alerts
FROM mitre_techniques t JOIN alert_mitre_mappings m ON m.mitre_technique_id = t.id
WHERE t.tactic = 'Execution' GROUP BY t.id, t.name, t.tactic""", ["mitre_techniques", "alert_mitre_mappings"]))
def f7(d: Domain):
    """F-7: the techniques of one tactic, with the alerts mapped to them."""
    from nightjar.operators.analytics import techniques_by_tactic
    t = techniques_by_tactic(d.mitre_techniques, "Execution")
    n = d.alert_mitre_mappings.groupBy(F.col("mitre_technique_id").alias("id")).agg(F.count("alert_id").alias("alerts"))
    return n.join(F.broadcast(t), "id").select("id", "name", "tactic", "alerts")


@register("so7_total_order", with_views(f"""
SELECT id, severity, row_number() OVER (ORDER BY {SEV_RANK} ASC NULLS LAST, id) AS place
FROM alerts ORDER BY place LIMIT 200""", ["alerts"]))
def so7(d: Domain):
    """SO-7: the first 200 alerts of the total order by severity rank, with
    their places, so that the order itself is compared."""
    from pyspark.sql import Window
    first = ls.ordered(d.alerts, "severity", "asc").limit(200).select("id", "severity")
    place = F.row_number().over(Window.orderBy(*ls.sort_key("severity", False), F.col("id")))
    return first.withColumn("place", place.cast("long"))


@register("sc16_json_fields", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.absent') AS absent
FROM events""")
def sc16(d: Domain):
    from nightjar.functions.scalars import json_field, variant_field
    return d.table("events").select("event_id", variant_field("props", "$.k", "bigint").alias("k"),
                                    json_field("props", "$.absent").alias("absent"))
