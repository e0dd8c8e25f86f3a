"""The adapter views of ``views.py`` written independently in DuckDB SQL, for
the oracle queries.  ``with_views(body, names)`` prefixes a query with the
CTEs it needs (dependencies resolved)."""

from __future__ import annotations

from nightjar import schemas
from nightjar.plans import views as V


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _case(expr: str, mapping: dict, default: str | None) -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {_q(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    d = "NULL" if default is None else (_q(default) if isinstance(default, str) else str(default))
    return f"CASE {expr} {whens} ELSE {d} END"


SEV = _list(schemas.SEVERITIES)
SRC_IP = "concat('10.0.', user_id % 256, '.', event_id % 256)"
TECH_IDS = _list([t[0] for t in schemas.MITRE_TECHNIQUES])
MSG = f"replace({_list(schemas.SAMPLE_MESSAGES)}[event_id % 6 + 1], '{{ip}}', {SRC_IP})"

VIEW_SQL: dict[str, tuple[list[str], str]] = {
    "mitre_techniques": ([], "SELECT id, name, tactic, concat('https://attack.mitre.org/techniques/', id, '/') AS url "
                             "FROM (VALUES " + ", ".join(f"({_q(i)}, {_q(n)}, {_q(t)})"
                                                         for i, n, t in schemas.MITRE_TECHNIQUES)
                         + ") AS t(id, name, tactic)"),
    "tactic_order": ([], "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(t)})" for i, t in
                                                            enumerate(schemas.TACTIC_ORDER))
                     + ") AS t(tactic_position, tactic)"),
    "ingestion_sources": ([], "SELECT CAST(id AS BIGINT) AS id, name, type, is_active, CAST(NULL AS VARCHAR) AS config, "
                              "CAST(NULL AS TIMESTAMP) AS last_ingested_at, "
                              f"TIMESTAMP '{V.USER_EPOCH}' + to_hours(CAST(id AS BIGINT)) AS created_at FROM (VALUES "
                          + ", ".join(f"({i}, {_q(n)}, {_q(t)}, {str(a).upper()})" for i, n, t, a in V.SOURCES)
                          + ") AS t(id, name, type, is_active)"),
    "assets": ([], f"""
SELECT c_custkey AS id, c_name AS name,
       {_case('c_mktsegment', V.SEGMENT_TYPE, 'other')} AS type,
       concat('10.', c_nationkey, '.', c_custkey % 256, '.', c_custkey % 251) AS ip_address,
       lower(replace(c_name, '#', '-')) AS hostname,
       {SEV}[c_nationkey % 5 + 1] AS criticality,
       CASE WHEN c_custkey % 3 <> 0 THEN concat('team-', c_nationkey % 4) END AS owner,
       CASE WHEN c_custkey % 4 = 0 THEN [lower(c_mktsegment), 'internet-facing'] ELSE [lower(c_mktsegment)] END AS tags,
       TIMESTAMP '{V.ASSET_EPOCH}' + to_minutes(c_custkey) AS created_at,
       TIMESTAMP '{V.ASSET_EPOCH}' + to_minutes(c_custkey) AS updated_at
FROM customer"""),
    "alerts": ([], f"""
SELECT event_id AS id,
       {_list(V.ALERT_TITLES)}[event_id % 6 + 1] AS title,
       concat('Event ', event_id, ' (', event_type, ')') AS description,
       {_case('event_type', V.EVENT_SEVERITY, 'info')} AS severity,
       {_list(schemas.ALERT_STATUSES)}[event_id % 4 + 1] AS status,
       {SRC_IP} AS source_ip,
       CASE WHEN event_id % 5 <> 0 THEN event_id % (SELECT count(*) FROM customer) END AS asset_id,
       CASE WHEN event_id % 7 <> 0 THEN CAST({_case('event_type', V.EVENT_SOURCE, None)} AS BIGINT) END
           AS ingestion_source_id,
       CASE WHEN event_id % 3 = 0 THEN event_id % (SELECT count(*) FROM supplier) END AS assigned_to_id,
       CASE WHEN event_id % 3 = 1 THEN event_id - event_id % 50 END AS incident_id,
       ts AS created_at, ts AS updated_at
FROM events"""),
    "alert_mitre_mappings": ([], f"""
SELECT event_id AS alert_id, {TECH_IDS}[event_id % 33 + 1] AS mitre_technique_id
FROM events WHERE event_id % 11 <> 0
UNION
SELECT event_id AS alert_id, {TECH_IDS}[(event_id * 7 + 1) % 33 + 1] AS mitre_technique_id
FROM events WHERE event_id % 11 <> 0 AND event_id % 3 = 0"""),
    "incidents": ([], f"""
SELECT id, title, severity, status, assigned_to_id, created_at, updated_at,
       CASE WHEN status IN ('resolved', 'closed') THEN created_at + INTERVAL 1 DAY END AS closed_at
FROM (
  SELECT event_id AS id, concat('Incident ', event_id, ': ', event_type) AS title,
         {_case('event_type', V.EVENT_SEVERITY, 'info')} AS severity,
         {_list(schemas.INCIDENT_STATUSES)}[(event_id // 50) % 5 + 1] AS status,
         CASE WHEN event_id % 150 <> 0 THEN user_id % (SELECT count(*) FROM supplier) END AS assigned_to_id,
         ts AS created_at, ts AS updated_at
  FROM events WHERE event_id % 50 = 0)"""),
    "incident_timeline_events": (["incidents"], """
SELECT concat(id, '-0') AS id, id AS incident_id, assigned_to_id AS author_id, 'note' AS event_type,
       'Incident opened' AS message, created_at FROM incidents
UNION ALL
SELECT concat(id, '-1') AS id, id AS incident_id, assigned_to_id AS author_id, 'status_change' AS event_type,
       concat('Status changed from open to ', status) AS message, created_at + INTERVAL 1 HOUR AS created_at
FROM incidents WHERE status <> 'open'"""),
    "vulnerabilities": ([], f"""
SELECT id, title, cve_id, severity, status, asset_id, discovered_at,
       CASE WHEN status = 'remediated' THEN discovered_at + INTERVAL 30 DAY END AS remediated_at, created_at
FROM (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
         concat('Package ', l_partkey, ' vulnerable') AS title,
         CASE WHEN l_partkey % 4 <> 0 THEN concat('CVE-', year(l_shipdate), '-', l_partkey) END AS cve_id,
         {SEV}[l_linenumber % 5 + 1] AS severity,
         CASE WHEN l_linestatus = 'O' THEN 'open' WHEN l_returnflag = 'R' THEN 'remediated'
              WHEN l_returnflag = 'A' THEN 'accepted_risk' ELSE 'false_positive' END AS status,
         CASE WHEN l_partkey % 50 = 0 THEN o_custkey END AS asset_id,
         l_shipdate AS discovered_at, o_orderdate AS created_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""),
    "raw_events": ([], f"""
SELECT event_id AS id, CAST({_case('event_type', V.EVENT_SOURCE, None)} AS BIGINT) AS ingestion_source_id,
       ts AS received_at, {SRC_IP} AS source_ip, 'syslog' AS normalized_type,
       concat('{{"sourceIp":"', {SRC_IP}, '","message":"', {MSG}, '"}}') AS payload
FROM events"""),
    "users": ([], f"""
SELECT s_suppkey AS id, concat('user', s_suppkey, '@example.com') AS email, s_name AS name,
       {_list(schemas.USER_ROLES)}[s_nationkey % 4 + 1] AS role, s_acctbal >= 0 AS is_active,
       TIMESTAMP '{V.USER_EPOCH}' + to_minutes(s_suppkey) AS created_at
FROM supplier"""),
    "notifications": ([], f"""
SELECT event_id AS id, event_id % (SELECT count(*) FROM supplier) AS user_id, {_case('event_type', V.NOTIFICATION_KIND, 'system')} AS type,
       concat('Notice ', event_id) AS title, event_type AS message,
       CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 1 HOUR END AS read_at, ts AS created_at
FROM events"""),
    "audit_logs": ([], f"""
SELECT event_id AS id,
       CASE WHEN event_id % 4 <> 0 THEN user_id % (SELECT count(*) FROM supplier) END AS actor_id,
       concat({_case('event_type', V.EVENT_ENTITY, 'alert')}, '.', ['created', 'updated', 'deleted'][event_id % 3 + 1])
           AS action,
       CASE WHEN event_id % 9 <> 0 THEN {_case('event_type', V.EVENT_ENTITY, 'alert')} END AS target_type,
       CASE WHEN event_id % 9 <> 0 THEN concat('tgt', CAST(event_id * 7919 AS VARCHAR)) END AS target_id,
       CASE WHEN event_id % 6 <> 0 THEN {SRC_IP} END AS ip_address,
       props AS metadata, ts AS created_at
FROM events"""),
    "iocs": ([], f"""
SELECT concat(type, ':', value) AS id, type, value, {SEV}[p0 % 5 + 1] AS severity,
       CAST(NULL AS VARCHAR) AS threat_actor_id,
       TIMESTAMP '{V.IOC_EPOCH}' + to_hours(p0) AS first_seen_at,
       TIMESTAMP '{V.IOC_EPOCH}' + to_hours(p1) AS last_seen_at,
       TIMESTAMP '{V.IOC_EPOCH}' + to_hours(p0) AS created_at
FROM (
  SELECT type, value, min(page_id) AS p0, max(page_id) AS p1 FROM (
    SELECT page_id, 'url' AS type, url AS value FROM pages
    UNION ALL
    SELECT page_id, 'domain' AS type, regexp_extract(url, '^https?://([^/]+)', 1) AS value FROM pages)
  GROUP BY type, value)"""),
    "syslog_lines": ([], f"""
SELECT event_id AS line_id,
       CASE WHEN event_id % 10 = 9 THEN concat('garbled line ', event_id)
            WHEN event_id % 10 = 3 THEN concat(' ', concat('<', event_id % 200, '>Jan  5 10:22:01 host', user_id, ' ',
                                                           {MSG}), chr(9))
            ELSE concat('<', event_id % 200, '>Jan  5 10:22:01 host', user_id, ' ', {MSG}) END AS raw,
       {SRC_IP} AS remote_address, ts AS received_at
FROM events"""),
    "http_requests": ([], """
SELECT event_id AS request_id, ts, event_type AS method, value * 10 AS duration_ms,
       CASE WHEN event_id % 100 < 6 THEN '500' ELSE '200' END AS status
FROM events"""),
    "ingestion_jobs": ([], """
SELECT event_id AS job_id, event_type AS queue, ts AS enqueued_at,
       ts + to_milliseconds(event_id % 20000) AS started_at, value < 40 AS succeeded
FROM events"""),
    "counter_samples": ([], """
SELECT concat('worker-', event_id % 7) AS series, ts, CAST((event_id // 7) % 400 AS DOUBLE) AS value FROM events"""),
    "connection_deltas": ([], """
SELECT event_type AS label, ts, event_id AS seq, CAST(CASE WHEN event_id % 3 = 2 THEN -1 ELSE 1 END AS BIGINT) AS delta
FROM events"""),
    "queue_gauges": ([], """
SELECT event_type AS queue, ts,
       CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 13 AS DOUBLE) END AS waiting,
       CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 3 AS DOUBLE) END AS active,
       CASE WHEN event_id % 6 <> 0 THEN CAST(event_id % 2 AS DOUBLE) END AS delayed
FROM events"""),
    "status_changes": ([], f"""
SELECT event_id AS change_id, (event_id % greatest((SELECT count(*) FROM events) // 40, 1)) * 50 AS entity_id, ts,
       CASE WHEN event_id % 6 <> 5 THEN {_list(schemas.INCIDENT_STATUSES)}[(event_id // 700) % 5 + 1] END AS status,
       event_id % 4 = 0 AS assigned_to_set,
       CASE WHEN event_id % 4 = 0 AND event_id % 8 <> 4 THEN user_id % 100 END AS assigned_to_id
FROM events"""),
    "vuln_changes": (["v"], """
SELECT concat(vid, '#0') AS change_id, vid AS entity_id, l_shipdate + INTERVAL 10 DAY AS ts,
       ['remediated', 'accepted_risk', 'open'][l_suppkey % 3 + 1] AS status FROM v
UNION ALL
SELECT concat(vid, '#1'), vid, l_shipdate + INTERVAL 20 DAY, 'remediated' FROM v
UNION ALL
SELECT concat(vid, '#x'), concat(vid, '-x'), l_shipdate + INTERVAL 5 DAY, 'remediated' FROM v WHERE l_returnflag = 'A'"""),
    "v": ([], "SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS vid FROM lineitem"),
    "ioc_incoming": ([], f"""
SELECT page_id * 10 AS incoming_id, 'domain' AS type, regexp_extract(url, '^https?://([^/]+)', 1) AS value,
       CAST(NULL AS VARCHAR) AS severity FROM pages
UNION ALL
SELECT page_id * 10 + 1, 'url', concat(url, '#v2'), CAST(NULL AS VARCHAR) FROM pages
UNION ALL
SELECT page_id * 10 + 2, 'ip', concat('203.0.113.', page_id % 50), {SEV}[page_id % 5 + 1] FROM pages"""),
    "ioc_patches": ([], """
SELECT page_id AS change_id, concat('url:', url) AS entity_id, TIMESTAMP '2024-02-01 00:00:00' + to_hours(page_id) AS ts,
       CASE WHEN page_id % 8 = 0 THEN 'critical' END AS severity FROM pages"""),
    "mapping_patches": ([], """
SELECT event_id AS change_id, event_id AS entity_id, ts,
       CASE WHEN event_id % 3 = 0 THEN CAST([] AS VARCHAR[]) WHEN event_id % 3 = 1 THEN ['T1078', 'T1059'] END
           AS mitre_technique_ids
FROM events
UNION ALL
SELECT event_id + 1000000000, event_id, ts + INTERVAL 1 HOUR, ['T1566'] FROM events WHERE event_type = 'error'"""),
    "incident_requests": ([], f"""
SELECT event_id AS request_id, concat('Case ', event_id) AS title,
       CASE WHEN value >= 10 THEN concat('Opened after ', event_type) END AS description, {_case('event_type', V.EVENT_SEVERITY, 'info')}
       AS severity, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS assigned_to_id,
       user_id % (SELECT count(*) FROM supplier) AS author_id, [event_id + 1, event_id + 2, event_id + 98, event_id + 100000000] AS alert_ids, ts
FROM events WHERE event_type = 'error'"""),
    "source_toggles": ([], """
SELECT event_id AS change_id, CAST(event_id % 7 + 1 AS BIGINT) AS entity_id, ts,
       value < 50 AS is_active FROM events WHERE event_type = 'signup'"""),
    "timeline_notes": ([], """
SELECT event_id AS note_id, (event_id % greatest((SELECT count(*) FROM events) // 45, 1)) * 50 AS incident_id, user_id % (SELECT count(*) FROM supplier) AS author_id,
       concat('Note ', event_id) AS message, ts FROM events WHERE event_type = 'click'"""),
    "alert_creates": ([], f"""
SELECT event_id AS id,
       CASE WHEN event_id % 90 = 0 THEN '' WHEN event_id % 45 = 0 THEN repeat('x', 201)
            ELSE concat('Manual alert ', event_id) END AS title,
       CAST(NULL AS VARCHAR) AS description,
       CASE WHEN event_type = 'view' THEN 'informational' WHEN event_type = 'click' THEN NULL
            ELSE {_case('event_type', V.EVENT_SEVERITY, None)} END AS severity,
       CAST(NULL AS VARCHAR) AS status, CASE WHEN event_id % 2 = 0 THEN ts END AS created_at
FROM events"""),
    "alert_changes": ([], f"""
SELECT event_id AS change_id, (event_id * 7) % (SELECT count(*) FROM events) AS entity_id, ts,
       CASE WHEN event_id % 3 = 0 THEN concat('Retitled ', event_id) END AS title,
       CASE WHEN event_id % 4 = 0 THEN {SEV}[event_id % 5 + 1] END AS severity,
       CASE WHEN event_id % 2 = 0 THEN {_list(schemas.ALERT_STATUSES)}[(event_id // 2) % 4 + 1] END AS status,
       event_id % 6 = 1 AS assigned_to_set,
       CASE WHEN event_id % 6 = 1 AND event_id % 12 <> 1 THEN user_id % (SELECT count(*) FROM supplier) END AS assigned_to_id
FROM events"""),
    "live_changes": (["alerts", "incidents", "alert_changes", "status_changes"], """
SELECT 'alert' AS entity, CAST(id AS VARCHAR) AS id, 'create' AS op, concat('create:', id) AS change_id, created_at AS ts,
       severity, status FROM alerts
UNION ALL
SELECT 'alert', CAST(entity_id AS VARCHAR), 'patch', concat('patch:', change_id), ts, severity, status FROM alert_changes
UNION ALL
SELECT 'alert', CAST(event_id AS VARCHAR), 'delete', concat('delete:', event_id), ts + INTERVAL 1 DAY, NULL, NULL
FROM events WHERE value >= 150
UNION ALL
SELECT 'incident', CAST(id AS VARCHAR), 'create', concat('create:', id), created_at, severity, status FROM incidents
UNION ALL
SELECT 'incident', CAST(entity_id AS VARCHAR), 'patch', concat('patch:', change_id), ts, NULL, status FROM status_changes"""),
}


def with_views(body: str, names: list[str], extra: dict[str, str] | None = None) -> str:
    """``WITH <needed views>, <extra CTEs> <body>`` in dependency order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEW_SQL[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [(n, VIEW_SQL[n][1]) for n in order] + list((extra or {}).items())
    ctes = ",\n".join(f"{n} AS ({sql.strip()})" for n, sql in parts)
    return f"WITH {ctes}\n{body.strip()}"
