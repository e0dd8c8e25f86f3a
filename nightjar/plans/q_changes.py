"""Registered change-application queries (M-*, W-2, W-3, J-8, J-9, J-11, F-11, SNK-7)."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar import schemas
from nightjar.operators import changes as ch
from nightjar.plans.oracle_views import with_views
from nightjar.plans.registry import AS_OF, AS_OF_SQL, register
from nightjar.plans.views import Domain


def _sha(*parts: str) -> str:
    return "sha256(concat_ws(chr(1), " + ", ".join(parts) + "))"


# -- M-1 / F-11 ----------------------------------------------------------------
@register("m1_alert_creates", with_views(f"""
SELECT id, title, description, severity, coalesce(status, 'open') AS status,
       coalesce(created_at, {AS_OF_SQL}) AS created_at, {AS_OF_SQL} AS updated_at
FROM alert_creates""", ["alert_creates"]))
def m1(d: Domain):
    return ch.apply_creates(d.alert_creates, "alerts", AS_OF)


@register("f11_validate_alerts", with_views("""
SELECT * FROM (
  SELECT id, concat_ws(',',
    CASE WHEN title IS NULL THEN 'title: required' END,
    CASE WHEN severity IS NULL THEN 'severity: required' END,
    CASE WHEN severity IS NOT NULL AND severity NOT IN ('critical', 'high', 'medium', 'low', 'info')
         THEN 'severity: invalid value' END,
    CASE WHEN status IS NOT NULL AND status NOT IN ('open', 'acknowledged', 'resolved', 'false_positive')
         THEN 'status: invalid value' END,
    CASE WHEN length(title) < 1 THEN 'title: too short' END,
    CASE WHEN length(title) > 200 THEN 'title: too long' END,
    CASE WHEN length(description) < 0 THEN 'description: too short' END,
    CASE WHEN length(description) > 4000 THEN 'description: too long' END) AS reasons
  FROM alert_creates) r
WHERE reasons <> ''""", ["alert_creates"]))
def f11(d: Domain):
    """F-11: rejected create requests with their reasons."""
    _valid, rejected = ch.validate(d.alert_creates, "alerts")
    return rejected.select("id", "reasons")


# -- M-2 / M-5 / W-2 / W-3 / M-10 / M-11 -------------------------------------------
KNOWN = "SELECT c.*, i.status AS snap_status, i.assigned_to_id AS snap_assignee, i.title AS snap_title " \
        "FROM status_changes c JOIN incidents i ON i.id = c.entity_id"
SEQ = f"""
SELECT *,
  coalesce(last_value(CASE WHEN status IS NOT NULL THEN {{'v': status}} END IGNORE NULLS) OVER w_before,
           {{'v': snap_status}}).v AS status_before,
  coalesce(last_value(CASE WHEN status IS NOT NULL THEN {{'v': status}} END IGNORE NULLS) OVER w_upto,
           {{'v': snap_status}}).v AS status_after,
  coalesce(last_value(CASE WHEN assigned_to_set THEN {{'v': assigned_to_id}} END IGNORE NULLS) OVER w_before,
           {{'v': snap_assignee}}).v AS assignee_before
FROM ({KNOWN}) k
WINDOW w_before AS (PARTITION BY entity_id ORDER BY ts, change_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
       w_upto AS (PARTITION BY entity_id ORDER BY ts, change_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def _incident_patch(d: Domain):
    return d.memo("patch_incidents", lambda: ch.patch_incidents(d.incidents, d.status_changes))


def _alert_patch(d: Domain):
    return d.memo("patch_alerts", lambda: ch.patch_alerts(d.alerts, d.alert_changes))


@register("m5_incident_snapshot", with_views("""
SELECT i.id, i.title, i.severity, CASE WHEN f.st_touched THEN f.st_new ELSE i.status END AS status,
       CASE WHEN f.as_touched THEN f.as_new ELSE i.assigned_to_id END AS assigned_to_id, i.created_at,
       greatest(i.updated_at, f.last_ts) AS updated_at, coalesce(i.closed_at, f.first_closed) AS closed_at
FROM incidents i LEFT JOIN (
  SELECT entity_id, max(ts) AS last_ts, bool_or(status IS NOT NULL) AS st_touched,
         arg_max(status, (ts, change_id)) FILTER (WHERE status IS NOT NULL) AS st_new,
         bool_or(assigned_to_set) AS as_touched,
         arg_max_null(assigned_to_id, (ts, change_id)) FILTER (WHERE assigned_to_set) AS as_new,
         min(ts) FILTER (WHERE status IN ('resolved', 'closed')) AS first_closed
  FROM status_changes GROUP BY entity_id) f ON f.entity_id = i.id""", ["incidents", "status_changes"]))
def m5(d: Domain):
    """M-5 + M-2 + W-2: the incident snapshot after a batch of patches."""
    return _incident_patch(d)["snapshot"]


@register("m2_unknown_patches", with_views("""
SELECT * FROM status_changes WHERE entity_id NOT IN (SELECT id FROM incidents)""", ["incidents", "status_changes"]))
def m2(d: Domain):
    return _incident_patch(d)["unknown"].select(*d.status_changes.columns)


@register("w3_status_timeline", with_views(f"""
SELECT {_sha("'timeline'", "CAST(change_id AS VARCHAR)")} AS id, entity_id AS incident_id, 'status_change' AS event_type,
       concat('Status changed from ', status_before, ' to ', status) AS message, ts AS created_at, change_id
FROM ({SEQ}) s WHERE status IS NOT NULL AND status <> status_before""", ["incidents", "status_changes"]))
def w3(d: Domain):
    """M-5 + W-3: a timeline row for every patch that changes the status."""
    return _incident_patch(d)["timeline"].drop("author_id")


@register("m11_assignment_notifications", with_views(f"""
SELECT {_sha("'notification'", "CAST(change_id AS VARCHAR)")} AS id, assigned_to_id AS user_id, 'incident' AS type,
       'Incident assigned to you' AS title, snap_title AS message, CAST(NULL AS TIMESTAMP) AS read_at,
       ts AS created_at, change_id
FROM ({SEQ}) s
WHERE assigned_to_set AND assigned_to_id IS NOT NULL AND (assignee_before IS NULL OR assigned_to_id <> assignee_before)""",
                                                     ["incidents", "status_changes"]))
def m11(d: Domain):
    return _incident_patch(d)["notifications"]


@register("m10_incident_audit", with_views(f"""
SELECT {_sha("'audit'", "'incident'", "CAST(change_id AS VARCHAR)")} AS id, CAST(NULL AS BIGINT) AS actor_id,
       'incident.updated' AS action, 'incident' AS target_type, CAST(entity_id AS VARCHAR) AS target_id,
       CAST(NULL AS VARCHAR) AS ip_address, json_object('status', status_after)::VARCHAR AS metadata, ts AS created_at
FROM ({SEQ}) s""", ["incidents", "status_changes"]))
def m10(d: Domain):
    """M-10 / SNK-7: the audit rows the patch batch appends."""
    return _incident_patch(d)["audit"]


@register("j11_quarantine", with_views("""
SELECT *, 'unknown entity_id' AS reason FROM status_changes
WHERE entity_id IS NOT NULL AND entity_id NOT IN (SELECT id FROM incidents)""", ["incidents", "status_changes"]))
def j11(d: Domain):
    _ok, bad = ch.referential_split(d.status_changes, d.incidents, "entity_id")
    return bad


# -- M-6 ---------------------------------------------------------------------------
@register("m6_vulnerability_remediation", with_views("""
SELECT v.id, CASE WHEN f.entity_id IS NOT NULL THEN f.st ELSE v.status END AS status,
       coalesce(v.remediated_at, f.first_rem) AS remediated_at
FROM vulnerabilities v LEFT JOIN (
  SELECT entity_id, arg_max(status, (ts, change_id)) AS st, min(ts) FILTER (WHERE status = 'remediated') AS first_rem
  FROM vuln_changes GROUP BY entity_id) f ON f.entity_id = v.id""", ["vulnerabilities", "vuln_changes"]))
def m6(d: Domain):
    """M-6 + W-2: remediated_at set once, at the first patch to remediated."""
    return ch.patch_vulnerabilities(d.vulnerabilities, d.vuln_changes)["snapshot"].select(
        "id", "status", "remediated_at")


# -- M-7 / J-9 ---------------------------------------------------------------------
@register("m7_ioc_inserted", with_views(f"""
SELECT concat(type, ':', value) AS id, type, value, coalesce(severity, 'medium') AS severity,
       CAST(NULL AS VARCHAR) AS threat_actor_id, {AS_OF_SQL} AS first_seen_at, {AS_OF_SQL} AS last_seen_at,
       {AS_OF_SQL} AS created_at
FROM (SELECT type, value, arg_min_null(severity, incoming_id) AS severity FROM ioc_incoming GROUP BY type, value) d
WHERE NOT EXISTS (SELECT 1 FROM iocs i WHERE i.type = d.type AND i.value = d.value)""", ["ioc_incoming", "iocs"]))
def m7(d: Domain):
    return ch.merge_iocs(d.iocs, d.ioc_incoming, AS_OF)["inserted"]


@register("j9_ioc_conflicts", with_views("""
SELECT type, value, incoming_id
FROM (SELECT *, row_number() OVER (PARTITION BY type, value ORDER BY incoming_id) AS rn FROM ioc_incoming) d
WHERE rn > 1 OR EXISTS (SELECT 1 FROM iocs i WHERE i.type = d.type AND i.value = d.value)""",
                                         ["ioc_incoming", "iocs"]))
def j9(d: Domain):
    return ch.merge_iocs(d.iocs, d.ioc_incoming, AS_OF)["conflicts"].select("type", "value", "incoming_id")


@register("m7_ioc_patched", with_views("""
SELECT i.id, CASE WHEN f.t THEN f.sev ELSE i.severity END AS severity,
       greatest(i.last_seen_at, f.last_ts) AS last_seen_at
FROM iocs i LEFT JOIN (
  SELECT entity_id, max(ts) AS last_ts, bool_or(severity IS NOT NULL) AS t,
         arg_max(severity, (ts, change_id)) FILTER (WHERE severity IS NOT NULL) AS sev
  FROM ioc_patches GROUP BY entity_id) f ON f.entity_id = i.id""", ["iocs", "ioc_patches"]))
def m7p(d: Domain):
    return ch.patch_iocs(d.iocs, d.ioc_patches)["snapshot"].select("id", "severity", "last_seen_at")


# -- M-3 ---------------------------------------------------------------------------
@register("m3_replaced_mappings", with_views("""
SELECT alert_id, mitre_technique_id FROM alert_mitre_mappings
WHERE alert_id NOT IN (SELECT entity_id FROM mapping_patches WHERE mitre_technique_ids IS NOT NULL)
UNION ALL
SELECT alert_id, unnest(list_distinct(ids)) AS mitre_technique_id FROM (
  SELECT entity_id AS alert_id, arg_max(mitre_technique_ids, (ts, change_id)) AS ids
  FROM mapping_patches WHERE mitre_technique_ids IS NOT NULL GROUP BY entity_id) l""",
                                             ["alert_mitre_mappings", "mapping_patches"]))
def m3(d: Domain):
    return ch.replace_mappings(d.alert_mitre_mappings, d.mapping_patches)


# -- M-4 / J-8 ---------------------------------------------------------------------
def _opened(d: Domain):
    return d.memo("open_incidents", lambda: ch.open_incidents(d.incidents, d.alerts, d.incident_timeline_events,
                                                              d.incident_requests, AS_OF))


@register("m4_created_incidents", with_views(f"""
SELECT {_sha("'incident'", "CAST(request_id AS VARCHAR)")} AS id, title, description, severity,
       coalesce(status, 'open') AS status, assigned_to_id, ts AS created_at, ts AS updated_at, CAST(NULL AS TIMESTAMP) AS closed_at
FROM incident_requests""", ["incident_requests"]))
def m4(d: Domain):
    return _opened(d)["created"]


@register("m4_incident_snapshot", with_views(f"""
SELECT CAST(id AS VARCHAR) AS id, title, CAST(NULL AS VARCHAR) AS description, severity, status, assigned_to_id,
       created_at, updated_at, closed_at
FROM incidents
UNION ALL
SELECT {_sha("'incident'", "CAST(request_id AS VARCHAR)")}, title, description, severity, coalesce(status, 'open'),
       assigned_to_id, ts, ts, CAST(NULL AS TIMESTAMP)
FROM incident_requests""", ["incident_requests", "incidents"]))
def m4s(d: Domain):
    """M-4: the incident table after the requests: all old rows and the new."""
    return _opened(d)["incidents"].select("id", "title", "description", "severity", "status", "assigned_to_id",
                                          "created_at", "updated_at", "closed_at")


@register("m4_seed_notes", with_views(f"""
SELECT {_sha("'opened'", "CAST(request_id AS VARCHAR)")} AS id,
       {_sha("'incident'", "CAST(request_id AS VARCHAR)")} AS incident_id, author_id, 'note' AS event_type,
       'Incident opened' AS message, ts AS created_at
FROM incident_requests""", ["incident_requests"]))
def m4n(d: Domain):
    return _opened(d)["notes"]


@register("j8_linked_alerts", with_views(f"""
SELECT alert_id AS id, arg_max({_sha("'incident'", "CAST(request_id AS VARCHAR)")}, (ts, request_id)) AS incident_id
FROM (SELECT request_id, ts, unnest(alert_ids) AS alert_id FROM incident_requests) r
WHERE alert_id IN (SELECT id FROM alerts) GROUP BY alert_id""", ["incident_requests", "alerts"]))
def j8(d: Domain):
    """M-4 + J-8: listed alerts that exist (semi join), linked to the newest
    request that lists them."""
    return _opened(d)["links"].select("id", F.col("_incident").alias("incident_id"))


# -- M-8 ---------------------------------------------------------------------------
@register("m8_mappings_after_alert_delete", with_views("""
SELECT * FROM alert_mitre_mappings WHERE alert_id NOT IN (SELECT id FROM alerts WHERE severity = 'info')""",
                                                       ["alert_mitre_mappings", "alerts"]))
def m8a(d: Domain):
    gone = d.alerts.where("severity = 'info'").select("id")
    return ch.delete_alerts(d.alerts, d.alert_mitre_mappings, gone)["alert_mitre_mappings"]


@register("m8_alerts_after_incident_delete", with_views("""
SELECT id, CASE WHEN incident_id IN (SELECT id FROM incidents WHERE status = 'closed') THEN NULL ELSE incident_id END
       AS incident_id
FROM alerts""", ["alerts", "incidents"]))
def m8b(d: Domain):
    gone = d.incidents.where("status = 'closed'").select("id")
    return ch.delete_incidents(d.incidents, d.alerts, d.incident_timeline_events, gone)["alerts"].select(
        "id", "incident_id")


# One deletion per entity, over every table that refers to it: which rows go
# is told by a column of the entity.
DELETIONS = {"alerts": "severity = 'info'", "incidents": "status = 'closed'", "assets": "criticality = 'low'",
             "users": "NOT is_active", "ingestion_sources": "NOT is_active",
             "mitre_techniques": "tactic = 'Discovery'"}
# The key of a child's row in the result, per table.
CHILD_KEY = {"alert_mitre_mappings": "concat(alert_id, ':', mitre_technique_id)"}


def _children(entity: str) -> list[tuple[str, str, str]]:
    return [(child, column, action) for child, column, parent, action in schemas.FOREIGN_KEYS
            if parent == entity and child != "iocs"]


def _deletion_sql(entity: str) -> str:
    gone = f"(SELECT id FROM {entity} WHERE {DELETIONS[entity]})"
    parts = [f"SELECT '{entity}' AS child, CAST(id AS VARCHAR) AS id, 'id' AS foreign_key, CAST(NULL AS VARCHAR) AS refers_to "
             f"FROM {entity} WHERE id NOT IN {gone}"]
    for child, column, action in _children(entity):
        key = f"CAST({CHILD_KEY.get(child, 'id')} AS VARCHAR)"
        parts.append(
            f"SELECT '{child}', {key}, '{column}', CAST({column} AS VARCHAR) FROM {child} "
            f"WHERE {column} IS NULL OR {column} NOT IN {gone}" if action == "cascade" else
            f"SELECT '{child}', {key}, '{column}', CASE WHEN {column} IN {gone} THEN NULL "
            f"ELSE CAST({column} AS VARCHAR) END FROM {child}")
    return with_views("\nUNION ALL\n".join(parts), [entity, *dict.fromkeys(c for c, _, _ in _children(entity))])


def _deletion(entity: str):
    def run(d: Domain):
        names = [entity, *dict.fromkeys(c for c, _, _ in _children(entity))]
        tables = {n: getattr(d, n) for n in names}
        out = ch.delete_entities(tables, entity, tables[entity].where(DELETIONS[entity]).select("id"))
        parts = [out[entity].select(F.lit(entity).alias("child"), F.col("id").cast("string").alias("id"),
                                    F.lit("id").alias("foreign_key"), F.lit(None).cast("string").alias("refers_to"))]
        for child, column, _ in _children(entity):
            parts.append(out[child].select(
                F.lit(child).alias("child"), F.expr(CHILD_KEY.get(child, "id")).cast("string").alias("id"),
                F.lit(column).alias("foreign_key"), F.col(column).cast("string").alias("refers_to")))
        return functools.reduce(DataFrame.unionByName, parts)
    run.__doc__ = f"M-8 by the foreign-key catalogue: {entity} deleted, with all of its children's tables after it."
    return run


for _entity in DELETIONS:
    register(f"m8_delete_{_entity}", _deletion_sql(_entity))(_deletion(_entity))


# -- M-9 ---------------------------------------------------------------------------
@register("m9_mark_all_read", with_views(f"""
SELECT id, CASE WHEN read_at IS NULL THEN {AS_OF_SQL} ELSE read_at END AS read_at
FROM notifications WHERE user_id = 7""", ["notifications"]))
def m9a(d: Domain):
    return ch.mark_read(d.notifications, 7, None, AS_OF).where(F.col("user_id") == 7).select("id", "read_at")


@register("m9_mark_read", with_views(f"""
SELECT id, user_id, CASE WHEN user_id = 7 AND read_at IS NULL THEN {AS_OF_SQL} ELSE read_at END AS read_at
FROM notifications WHERE type = 'incident'""", ["notifications"]))
def m9b(d: Domain):
    ids = d.notifications.where("type = 'incident'").select("id")
    return (ch.mark_read(d.notifications, 7, ids, AS_OF).join(ids, "id", "left_semi")
            .select("id", "user_id", "read_at"))


# -- M-12 --------------------------------------------------------------------------
@register("m12_sources_after_toggle", with_views("""
SELECT s.id, s.name, s.type, CASE WHEN f.entity_id IS NOT NULL THEN f.a ELSE s.is_active END AS is_active
FROM ingestion_sources s LEFT JOIN (
  SELECT entity_id, arg_max(is_active, (ts, change_id)) AS a FROM source_toggles GROUP BY entity_id) f
ON f.entity_id = s.id""", ["ingestion_sources", "source_toggles"]))
def m12(d: Domain):
    return ch.toggle_sources(d.ingestion_sources, d.source_toggles)["snapshot"].select("id", "name", "type",
                                                                                       "is_active")


@register("m12_toggle_audit", with_views(f"""
SELECT {_sha("'audit'", "'ingestion_source'", "CAST(change_id AS VARCHAR)")} AS id, CAST(NULL AS BIGINT) AS actor_id,
       CASE WHEN t.is_active THEN 'ingestion_source.enabled' ELSE 'ingestion_source.disabled' END AS action,
       'ingestion_source' AS target_type, CAST(t.entity_id AS VARCHAR) AS target_id,
       CAST(NULL AS VARCHAR) AS ip_address, json_object('type', s.type)::VARCHAR AS metadata, t.ts AS created_at
FROM source_toggles t JOIN ingestion_sources s ON s.id = t.entity_id""", ["ingestion_sources", "source_toggles"]))
def m12a(d: Domain):
    return ch.toggle_sources(d.ingestion_sources, d.source_toggles)["audit"]


# -- M-13 --------------------------------------------------------------------------
@register("m13_notes_added", with_views(f"""
SELECT {_sha("'note'", "CAST(note_id AS VARCHAR)")} AS id, incident_id, author_id, 'note' AS event_type, message,
       ts AS created_at
FROM timeline_notes WHERE incident_id IN (SELECT id FROM incidents)""", ["timeline_notes", "incidents"]))
def m13(d: Domain):
    return ch.append_timeline_notes(d.incident_timeline_events, d.incidents, d.timeline_notes)["added"]


# -- M-2 / M-11 / M-10 for alerts ---------------------------------------------------
ALERT_SNAPSHOT = """
SELECT a.id, CASE WHEN f.t_t THEN f.t_new ELSE a.title END AS title,
       CASE WHEN f.s_t THEN f.s_new ELSE a.severity END AS severity,
       CASE WHEN f.st_t THEN f.st_new ELSE a.status END AS status,
       CASE WHEN f.a_t THEN f.a_new ELSE a.assigned_to_id END AS assigned_to_id,
       greatest(a.updated_at, f.last_ts) AS updated_at
FROM alerts a LEFT JOIN (
  SELECT entity_id, max(ts) AS last_ts,
         bool_or(title IS NOT NULL) AS t_t, arg_max(title, (ts, change_id)) FILTER (WHERE title IS NOT NULL) AS t_new,
         bool_or(severity IS NOT NULL) AS s_t,
         arg_max(severity, (ts, change_id)) FILTER (WHERE severity IS NOT NULL) AS s_new,
         bool_or(status IS NOT NULL) AS st_t,
         arg_max(status, (ts, change_id)) FILTER (WHERE status IS NOT NULL) AS st_new,
         bool_or(assigned_to_set) AS a_t,
         arg_max_null(assigned_to_id, (ts, change_id)) FILTER (WHERE assigned_to_set) AS a_new
  FROM alert_changes GROUP BY entity_id) f ON f.entity_id = a.id"""


@register("m2_alert_snapshot", with_views(ALERT_SNAPSHOT, ["alerts", "alert_changes"]))
def m2a(d: Domain):
    """M-2 for alerts: tri-state field patches folded per alert."""
    return _alert_patch(d)["snapshot"].select(
        "id", "title", "severity", "status", "assigned_to_id", "updated_at")


@register("m2_alert_buckets", with_views(ALERT_SNAPSHOT, ["alerts", "alert_changes"]))
def m2_buckets(d: Domain):
    """M-2 by the job on the alerts in id buckets, with a retry; read back."""
    from nightjar.plans.jobs import patch_job
    from nightjar.session import checkpoint_path
    from nightjar.sinks.snapshots import write_bucketed
    root = checkpoint_path(d.spark, f"wh-{uuid.uuid4().hex}")
    write_bucketed(d.alerts, f"{root}/alerts", buckets=16)
    for _ in range(2):
        patch_job(d.spark, root, "alerts", d.alert_changes, "b1", buckets=16)
    return d.spark.read.parquet(f"{root}/alerts").select(
        "id", "title", "severity", "status", "assigned_to_id", "updated_at")


ALERT_SEQ = f"""
SELECT *,
  coalesce(last_value(CASE WHEN title IS NOT NULL THEN {{'v': title}} END IGNORE NULLS) OVER w_upto,
           {{'v': snap_title}}).v AS title_after,
  coalesce(last_value(CASE WHEN status IS NOT NULL THEN {{'v': status}} END IGNORE NULLS) OVER w_upto,
           {{'v': snap_status}}).v AS status_after,
  coalesce(last_value(CASE WHEN assigned_to_set THEN {{'v': assigned_to_id}} END IGNORE NULLS) OVER w_before,
           {{'v': snap_assignee}}).v AS assignee_before
FROM (SELECT c.*, a.title AS snap_title, a.status AS snap_status, a.assigned_to_id AS snap_assignee
      FROM alert_changes c JOIN alerts a ON a.id = c.entity_id) k
WINDOW w_before AS (PARTITION BY entity_id ORDER BY ts, change_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
       w_upto AS (PARTITION BY entity_id ORDER BY ts, change_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@register("m11_alert_notifications", with_views(f"""
SELECT {_sha("'notification'", "CAST(change_id AS VARCHAR)")} AS id, assigned_to_id AS user_id, 'alert' AS type,
       'Alert assigned to you' AS title, title_after AS message, CAST(NULL AS TIMESTAMP) AS read_at,
       ts AS created_at, change_id
FROM ({ALERT_SEQ}) s
WHERE assigned_to_set AND assigned_to_id IS NOT NULL AND (assignee_before IS NULL OR assigned_to_id <> assignee_before)""",
                                                ["alerts", "alert_changes"]))
def m11a(d: Domain):
    """M-11 for alerts: the message is the alert title after the patch."""
    return _alert_patch(d)["notifications"]


@register("m10_alert_audit", with_views(f"""
SELECT {_sha("'audit'", "'alert'", "CAST(change_id AS VARCHAR)")} AS id, CAST(NULL AS BIGINT) AS actor_id,
       'alert.updated' AS action, 'alert' AS target_type, CAST(entity_id AS VARCHAR) AS target_id,
       CAST(NULL AS VARCHAR) AS ip_address, json_object('status', status_after)::VARCHAR AS metadata, ts AS created_at
FROM ({ALERT_SEQ}) s""", ["alerts", "alert_changes"]))
def m10a(d: Domain):
    return _alert_patch(d)["audit"]


# -- SNK-7: audit rows of a batch, written once whatever the retries ------------------
@register("snk7_audit_sink", with_views(f"""
SELECT created_date, count(*) AS n FROM (
  SELECT CAST(ts AS DATE) AS created_date FROM source_toggles t JOIN ingestion_sources s ON s.id = t.entity_id) a
GROUP BY created_date""", ["ingestion_sources", "source_toggles"]))
def snk7(d: Domain):
    """SNK-7: the toggles' audit rows written twice under one batch id, as a
    retry does, and read back: every row is there once."""
    from nightjar.session import checkpoint_path
    from nightjar.sinks.ingest import audit_sink
    path = checkpoint_path(d.spark, f"audit-{uuid.uuid4().hex}")
    rows = ch.toggle_sources(d.ingestion_sources, d.source_toggles)["audit"]
    for _ in range(2):
        audit_sink(rows, path, batch_id="b1")
    return d.spark.read.parquet(path).groupBy("created_date").agg(F.count(F.lit(1)).alias("n"))


# -- SRC-4 / SRC-6 -------------------------------------------------------------------
@register("src4_scan_alerts", with_views("""
SELECT id, severity, status, created_at FROM alerts""", ["alerts"]))
def src4(d: Domain):
    """SRC-4: the alert table written as a version and scanned with its
    declared columns (ids are text at rest)."""
    from nightjar.session import checkpoint_path
    from nightjar.sinks.snapshots import write_version
    from nightjar.sources.tables import scan
    root = checkpoint_path(d.spark, f"wh-{uuid.uuid4().hex}")
    write_version(d.alerts, f"{root}/alerts")
    return scan(d.spark, f"{root}/alerts", "alerts").select(F.col("id").cast("long").alias("id"), "severity", "status",
                                                            "created_at")


@register("src6_sources_by_type", with_views("""
SELECT id, name, type FROM ingestion_sources
UNION ALL
SELECT min(event_id), arg_min(concat('source of ', event_type), event_id), concat('feed_', event_type) FROM events
GROUP BY event_type""", ["ingestion_sources"]))
def src6(d: Domain):
    """SRC-6: every event asks for a source of its type; one per type is made."""
    from nightjar.sources.tables import ensure_sources
    e = d.table("events")
    wanted = e.select(F.col("event_id").alias("id"), F.concat(F.lit("source of "), "event_type").alias("name"),
                      F.concat(F.lit("feed_"), "event_type").alias("type"))
    return ensure_sources(d.ingestion_sources.select("id", "name", "type"), wanted)
