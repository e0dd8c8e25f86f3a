"""Registered detection / syslog / ingest queries (SC-1, SC-2, DET-*, SNK-5, SNK-6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar import schemas
from nightjar.functions.scalars import keep_rows
from nightjar.functions.syslog import syslog_payload, with_parsed_syslog
from nightjar.operators.detect import detect
from nightjar.plans.oracle_views import _list, _q, with_views
from nightjar.plans.registry import register
from nightjar.plans.views import Domain
from nightjar.sinks.ingest import process_ingestion, realtime_feed, refresh_source_freshness

SYSLOG_SOURCE_ID = 2


# The rules as the oracle states them, apart from the library's own table:
# pattern, title, description, severity, techniques.  Fixed values.
ORACLE_RULES = [
    ("failed password|authentication failure|invalid user", "Failed authentication attempt detected",
     "Ingested telemetry matched a failed-authentication pattern", "medium", "T1110"),
    ("sudo:.*COMMAND=", "Privileged command execution via sudo",
     "Ingested telemetry recorded a sudo command execution", "low", "T1548"),
    ("ransomware|malware detected|trojan", "Malware indicator in ingested telemetry",
     "Ingested telemetry matched a known malware/ransomware keyword", "critical", "T1486"),
]


def _detect_sql(text: str, ip: str) -> dict[str, str]:
    """CASE chains for the rule fields (first match wins)."""
    def chain(val) -> str:
        whens = " ".join(f"WHEN regexp_matches({text}, {_q('(?i)' + r[0])}) THEN {val(r)}" for r in ORACLE_RULES)
        return f"CASE {whens} END"
    frm = f"CASE WHEN length({ip}) > 0 THEN concat(' from ', {ip}) ELSE '' END"
    return {
        "title": chain(lambda r: _q(r[1])),
        "severity": chain(lambda r: _q(r[3])),
        "description": chain(lambda r: f"concat({_q(r[2])}, {frm}, '.')"),
        "mitre_technique_ids": chain(lambda r: _q(r[4])),
    }


def _detected_cols(prefix: str = "") -> list:
    return [F.col("detection.title").alias("title"), F.col("detection.severity").alias("severity"),
            F.col("detection.description").alias("description"),
            F.col("detection.mitre_technique_ids").alias("mitre_technique_ids")]


RAW_DET = _detect_sql("payload", "source_ip")


@register("det1_detect_raw_events", with_views(f"""
SELECT id, {RAW_DET['title']} AS title, {RAW_DET['severity']} AS severity,
       {RAW_DET['description']} AS description, {RAW_DET['mitre_technique_ids']} AS mitre_technique_ids
FROM raw_events""", ["raw_events"]))
def det1(d: Domain):
    """DET-1..4 over every raw event (null fields = benign)."""
    return detect(d.raw_events).select("id", *_detected_cols())


@register("det2_rule_hits", with_views(f"""
SELECT coalesce({RAW_DET['title']}, 'none') AS rule_title, ingestion_source_id, count(*) AS hits
FROM raw_events GROUP BY 1, 2""", ["raw_events"]))
def det2(d: Domain):
    """Hits per rule and source (benign = 'none'), aggregated map-side."""
    return (detect(d.raw_events).groupBy(F.coalesce("detection.title", F.lit("none")).alias("rule_title"),
                                         "ingestion_source_id")
            .agg(F.count(F.lit(1)).alias("hits")))


TRIMMED = "regexp_replace(raw, '^\\s+|\\s+$', '', 'g')"
PAT = schemas.SYSLOG_PATTERN
PARSE_SQL = f"""
SELECT line_id, raw, remote_address, received_at, m,
       TRY_CAST(regexp_extract(t, {_q(PAT)}, 1) AS INTEGER) AS pri, t
FROM (SELECT *, {TRIMMED} AS t, regexp_matches({TRIMMED}, {_q(PAT)}) AS m FROM syslog_lines)"""
FIELDS_SQL = f"""
coalesce({_list(schemas.SYSLOG_FACILITIES)}[pri // 8 + 1], 'unknown') AS facility,
coalesce({_list(schemas.SYSLOG_SEVERITIES)}[pri % 8 + 1], 'unknown') AS severity,
regexp_extract(t, {_q(PAT)}, 3) AS host,
regexp_replace(regexp_extract(t, {_q(PAT)}, 4), '^\\s+|\\s+$', '', 'g') AS tag,
regexp_extract(t, {_q(PAT)}, 5) AS message"""


@register("sc1_parse_syslog", with_views(f"""
SELECT line_id,
       CASE WHEN m THEN coalesce({_list(schemas.SYSLOG_FACILITIES)}[pri // 8 + 1], 'unknown') END AS facility,
       CASE WHEN m THEN coalesce({_list(schemas.SYSLOG_SEVERITIES)}[pri % 8 + 1], 'unknown') END AS severity,
       CASE WHEN m THEN regexp_extract(t, {_q(PAT)}, 3) END AS host,
       CASE WHEN m THEN regexp_replace(regexp_extract(t, {_q(PAT)}, 4), '^\\s+|\\s+$', '', 'g') END AS tag,
       CASE WHEN m THEN regexp_extract(t, {_q(PAT)}, 5) END AS message
FROM ({PARSE_SQL}) p""", ["syslog_lines"]))
def sc1(d: Domain):
    """SC-1 on every line: null fields when the line is not RFC 3164."""
    p = with_parsed_syslog(d.syslog_lines.select("line_id", "raw"), "raw", "p")
    return p.select("line_id", *[F.col(f"p.{c}").alias(c) for c in ("facility", "severity", "host", "tag", "message")])


NORMALIZED_SQL = f"""
SELECT line_id, remote_address AS source_ip, 'syslog' AS normalized_type, received_at,
       json_object('facility', facility, 'severity', severity, 'host', host, 'tag', tag, 'message', message,
                   'raw', raw)::VARCHAR AS payload
FROM (SELECT line_id, raw, remote_address, received_at, {FIELDS_SQL} FROM ({PARSE_SQL}) p WHERE m) q"""


def _normalized(d: Domain):
    p = keep_rows(with_parsed_syslog(d.syslog_lines), F.col("parsed").isNotNull())
    return p.select("line_id", F.col("remote_address").alias("source_ip"), F.lit("syslog").alias("normalized_type"),
                    "received_at", syslog_payload("parsed", "raw").alias("payload"))


@register("sc2_normalize_syslog", with_views(NORMALIZED_SQL, ["syslog_lines"]))
def sc2(d: Domain):
    """SC-2 / SRC-3: parsable lines → normalised events (payload JSON text in
    field order, raw line included); unparsable lines dropped."""
    return _normalized(d)


RAW_ID = f"sha256(concat_ws(chr(1), 'raw', '{SYSLOG_SOURCE_ID}', CAST(line_id AS VARCHAR)))"
ING_DET = _detect_sql("payload", "source_ip")


@register("det5_ingest_syslog", with_views(f"""
SELECT sha256(concat_ws(chr(1), 'alert', raw_id)) AS id, raw_id AS raw_event_id, title, description, severity,
       'open' AS status, source_ip, CAST({SYSLOG_SOURCE_ID} AS BIGINT) AS ingestion_source_id,
       received_at AS created_at, mitre_technique_ids
FROM (SELECT {RAW_ID} AS raw_id, source_ip, received_at, {ING_DET['title']} AS title,
             {ING_DET['description']} AS description, {ING_DET['severity']} AS severity,
             {ING_DET['mitre_technique_ids']} AS mitre_technique_ids
      FROM ({NORMALIZED_SQL}) n) x
WHERE title IS NOT NULL""", ["syslog_lines"]))
def det5(d: Domain):
    """DET-5 end to end over the syslog stream text: parse → land → detect →
    alerts (with technique ids from the mapping rows)."""
    events = _normalized(d).withColumn("ingestion_source_id", F.lit(SYSLOG_SOURCE_ID).cast("long"))
    out = process_ingestion(events, d.ingestion_sources, key_col="line_id")
    return out["alerts_serialized"].select(
        "id", "raw_event_id", "title", "description", "severity", "status", "source_ip", "ingestion_source_id",
        "created_at", "mitre_technique_ids")


@register("snk6_source_freshness", with_views("""
SELECT s.id, s.name, s.type, s.is_active, s.config, greatest(s.last_ingested_at, r.newest) AS last_ingested_at,
       s.created_at
FROM ingestion_sources s
LEFT JOIN (SELECT ingestion_source_id, max(received_at) AS newest FROM raw_events GROUP BY 1) r
       ON r.ingestion_source_id = s.id""", ["ingestion_sources", "raw_events"]))
def snk6(d: Domain):
    return refresh_source_freshness(d.ingestion_sources, d.raw_events)


@register("snk5_incident_feed", with_views("""
SELECT json_object('type', 'incident.created', 'data', json_object(
         'id', id, 'title', title, 'severity', severity, 'status', status, 'assigned_to_id', assigned_to_id,
         'created_at', strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z',
         'updated_at', strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z',
         'closed_at', strftime(closed_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'))::VARCHAR AS message
FROM incidents""", ["incidents"]))
def snk5(d: Domain):
    """SNK-5: one realtime message per incident row."""
    return realtime_feed(d.incidents, "incident.created")


def _csv_cell_sql(expr: str) -> str:
    v = f"coalesce(CAST({expr} AS VARCHAR), '')"
    return (f"CASE WHEN regexp_matches({v}, '[\",\n]') THEN concat('\"', replace({v}, '\"', '\"\"'), '\"') "
            f"ELSE {v} END")


@register("snk1_audit_export_lines", with_views(
    "SELECT concat_ws(',', " + ", ".join(_csv_cell_sql(c) for c in (
        "id", "actor_id", "action", "target_type", "target_id", "ip_address", "metadata",
        "strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'")) + ") AS line FROM audit_logs", ["audit_logs"]))
def snk1(d: Domain):
    """SNK-1 / SC-13: the CSV body lines of an audit export (ISO times, null →
    empty, quotes only around text holding a quote, comma or newline)."""
    from nightjar.sinks.export import csv_text, export_rows
    return csv_text(export_rows(d.audit_logs))
