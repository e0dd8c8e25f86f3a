"""Adapter: the driver's synthetic tables → the security domain tables.

The test tables are not security data, so each domain table is *derived*
from them with plain projections (no joins except lineitem⋈orders; table
row counts are scalar subqueries), so every domain table grows with the input.  The same
definitions are written in DuckDB SQL in ``oracle_views.py``; the oracle
therefore checks the adapter and the operator together.

Mapping rules (shared with the SQL text):

* assets ← customer (id = c_custkey, type by market segment, criticality by
  ``c_nationkey % 5``).
* alerts, raw events, notifications, audit rows, metric samples ← events.
* incidents ← every 50th event; vulnerabilities ← lineitem ⋈ orders.
* iocs ← pages (the URL and its host), users ← supplier.
"""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar import schemas
from nightjar.functions.scalars import map_values
from nightjar.sources.tables import mitre_dimension

# Fixed values of the adapter (mirrored verbatim in oracle_views.py).
AS_OF = dt.datetime(2024, 1, 31, 0, 0, 0)
ASSET_EPOCH = "2023-12-01 00:00:00"
USER_EPOCH = "2023-11-01 00:00:00"
IOC_EPOCH = "2023-12-15 00:00:00"
SEGMENT_TYPE = {"AUTOMOBILE": "server", "BUILDING": "workstation", "FURNITURE": "network_device",
                "HOUSEHOLD": "cloud_resource", "MACHINERY": "other"}
EVENT_SEVERITY = {"error": "critical", "purchase": "high", "signup": "medium", "click": "low", "view": "info"}
EVENT_SOURCE = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
EVENT_ENTITY = {"click": "alert", "error": "incident", "purchase": "vulnerability", "signup": "asset",
                "view": "ioc"}
NOTIFICATION_KIND = {"error": "alert", "purchase": "incident"}
ALERT_TITLES = [
    "Failed authentication attempt detected",
    "Privileged command execution via sudo",
    "Malware indicator in ingested telemetry",
    "Suspicious outbound connection",
    "Impossible travel sign-in",
    "Policy violation",
]
SOURCES = [  # id, name, type, is_active
    (1, "click stream", "demo_generator", True),
    (2, "error log", "syslog", True),
    (3, "purchase feed", "file_upload", False),
    (4, "signup hook", "webhook", True),
    (5, "view stream", "syslog", False),
    (6, "idle upload", "file_upload", False),
]


def _pick(values: list, idx: Column) -> Column:
    """values[idx] for a literal list (0-based), stays a native expression."""
    return F.get(F.array(*[F.lit(v) for v in values]), idx.cast("int"))


def _ts_plus(unit: str, amount: str, base: str) -> Column:
    return F.expr(f"timestampadd({unit}, {amount}, {base})")


_SCANS: dict[tuple[str, str], DataFrame] = {}


class Domain:
    """Lazily built domain DataFrames over one ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def memo(self, key: str, build):
        """Build a derived result once per Domain (lazy plans are immutable,
        so queries sharing an operator result reuse its plan)."""
        cache = self.__dict__.setdefault("_memo", {})
        if key not in cache:
            cache[key] = build()
        return cache[key]

    def table(self, name: str) -> DataFrame:
        """The driver's table as a lazy scan; the relation (file listing and
        footer schema) is resolved once per session and path and reused."""
        key = (self.spark._jsparkSession.sessionUUID(), f"{self.sf_dir}/{name}.parquet")
        df = _SCANS.get(key)
        if df is None:
            df = _SCANS[key] = self.spark.read.parquet(key[1])
        return df

    # -- dimensions ---------------------------------------------------------
    @functools.cached_property
    def mitre_techniques(self) -> DataFrame:
        return mitre_dimension(self.spark)

    @functools.cached_property
    def ingestion_sources(self) -> DataFrame:
        rows = [(i, n, t, a) for i, n, t, a in SOURCES]
        df = self.spark.createDataFrame(rows, "id long, name string, type string, is_active boolean")
        return df.select(
            "id", "name", "type", "is_active", F.lit(None).cast("string").alias("config"),
            F.lit(None).cast("timestamp_ntz").alias("last_ingested_at"),
            F.expr(f"timestampadd(HOUR, id, TIMESTAMP_NTZ'{USER_EPOCH}')").alias("created_at"),
        )

    @functools.cached_property
    def n_customers(self) -> Column:
        """Row count of ``customer`` as a scalar subquery (run once, no join)."""
        return self.table("customer").agg(F.count(F.lit(1))).scalar()

    @functools.cached_property
    def n_users(self) -> Column:
        """Row count of ``supplier`` (the users) as a scalar subquery."""
        return self.table("supplier").agg(F.count(F.lit(1))).scalar()

    @functools.cached_property
    def n_events(self) -> Column:
        """Row count of ``events``: change logs touch ids all over the tables."""
        return self.table("events").agg(F.count(F.lit(1))).scalar()

    # -- entities -----------------------------------------------------------
    @functools.cached_property
    def assets(self) -> DataFrame:
        c = self.table("customer")
        seg = F.lower(F.col("c_mktsegment"))
        return c.select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            map_values("c_mktsegment", SEGMENT_TYPE, "other").alias("type"),
            F.concat(F.lit("10."), F.col("c_nationkey"), F.lit("."), F.col("c_custkey") % 256, F.lit("."),
                     F.col("c_custkey") % 251).alias("ip_address"),
            F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("-"))).alias("hostname"),
            _pick(schemas.SEVERITIES, F.col("c_nationkey") % 5).alias("criticality"),
            F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("team-"), F.col("c_nationkey") % 4)).alias("owner"),
            F.when(F.col("c_custkey") % 4 == 0, F.array(seg, F.lit("internet-facing")))
            .otherwise(F.array(seg)).alias("tags"),
            _ts_plus("MINUTE", "c_custkey", f"TIMESTAMP_NTZ'{ASSET_EPOCH}'").alias("created_at"),
            _ts_plus("MINUTE", "c_custkey", f"TIMESTAMP_NTZ'{ASSET_EPOCH}'").alias("updated_at"),
        )

    def _source_ip(self) -> Column:
        return F.concat(F.lit("10.0."), F.col("user_id") % 256, F.lit("."), F.col("event_id") % 256)

    @functools.cached_property
    def alerts(self) -> DataFrame:
        e = self.table("events")
        eid = F.col("event_id")
        return e.select(
            eid.alias("id"),
            _pick(ALERT_TITLES, eid % 6).alias("title"),
            F.concat(F.lit("Event "), eid, F.lit(" ("), F.col("event_type"), F.lit(")")).alias("description"),
            map_values("event_type", EVENT_SEVERITY, "info").alias("severity"),
            _pick(schemas.ALERT_STATUSES, eid % 4).alias("status"),
            self._source_ip().alias("source_ip"),
            F.when(eid % 5 != 0, eid % self.n_customers).alias("asset_id"),
            F.when(eid % 7 != 0, map_values("event_type", EVENT_SOURCE).cast("long")).alias("ingestion_source_id"),
            F.when(eid % 3 == 0, eid % self.n_users).alias("assigned_to_id"),
            F.when(eid % 3 == 1, eid - eid % 50).alias("incident_id"),
            F.col("ts").alias("created_at"),
            F.col("ts").alias("updated_at"),
        )

    @functools.cached_property
    def alert_mitre_mappings(self) -> DataFrame:
        ids = [t[0] for t in schemas.MITRE_TECHNIQUES]
        eid = F.col("event_id")
        first = _pick(ids, eid % 33)
        second = F.when(eid % 3 == 0, _pick(ids, (eid * 7 + 1) % 33))
        techs = F.array_distinct(F.filter(F.array(first, second), lambda x: x.isNotNull()))
        return (self.table("events").where(eid % 11 != 0)
                .select(eid.alias("alert_id"), F.explode(techs).alias("mitre_technique_id")))

    @functools.cached_property
    def incidents(self) -> DataFrame:
        e = self.table("events").where(F.col("event_id") % 50 == 0)
        eid = F.col("event_id")
        status = _pick(schemas.INCIDENT_STATUSES, F.expr("(event_id div 50) % 5"))
        return e.select(
            eid.alias("id"),
            F.concat(F.lit("Incident "), eid, F.lit(": "), F.col("event_type")).alias("title"),
            map_values("event_type", EVENT_SEVERITY, "info").alias("severity"),
            status.alias("status"),
            F.when(eid % 150 != 0, F.col("user_id") % self.n_users).alias("assigned_to_id"),
            F.col("ts").alias("created_at"),
            F.col("ts").alias("updated_at"),
            F.when(status.isin(*schemas.CLOSED_INCIDENT_STATUSES), _ts_plus("DAY", "1", "ts")).alias("closed_at"),
        )

    @functools.cached_property
    def incident_timeline_events(self) -> DataFrame:
        inc = self.incidents
        opened = inc.select(
            F.concat(F.col("id"), F.lit("-0")).alias("id"), F.col("id").alias("incident_id"),
            F.col("assigned_to_id").alias("author_id"), F.lit("note").alias("event_type"),
            F.lit("Incident opened").alias("message"), F.col("created_at"))
        changed = inc.where(F.col("status") != "open").select(
            F.concat(F.col("id"), F.lit("-1")).alias("id"), F.col("id").alias("incident_id"),
            F.col("assigned_to_id").alias("author_id"), F.lit("status_change").alias("event_type"),
            F.concat(F.lit("Status changed from open to "), F.col("status")).alias("message"),
            _ts_plus("HOUR", "1", "created_at").alias("created_at"))
        return opened.unionByName(changed)

    @functools.cached_property
    def vulnerabilities(self) -> DataFrame:
        li = self.table("lineitem")
        od = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        j = li.join(od, li.l_orderkey == od.o_orderkey)
        status = (F.when(F.col("l_linestatus") == "O", "open")
                  .when(F.col("l_returnflag") == "R", "remediated")
                  .when(F.col("l_returnflag") == "A", "accepted_risk")
                  .otherwise("false_positive"))
        return j.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
            F.concat(F.lit("Package "), F.col("l_partkey"), F.lit(" vulnerable")).alias("title"),
            F.when(F.col("l_partkey") % 4 != 0,
                   F.concat(F.lit("CVE-"), F.year("l_shipdate"), F.lit("-"), F.col("l_partkey"))).alias("cve_id"),
            _pick(schemas.SEVERITIES, F.col("l_linenumber") % 5).alias("severity"),
            status.alias("status"),
            F.when(F.col("l_partkey") % 50 == 0, F.col("o_custkey")).alias("asset_id"),
            F.col("l_shipdate").alias("discovered_at"),
            F.when(status == "remediated", _ts_plus("DAY", "30", "l_shipdate")).alias("remediated_at"),
            F.col("o_orderdate").alias("created_at"),
        )

    @functools.cached_property
    def raw_events(self) -> DataFrame:
        e = self.table("events")
        ip = self._source_ip()
        msg = F.replace(_pick(schemas.SAMPLE_MESSAGES, F.col("event_id") % 6), F.lit("{ip}"), ip)
        return e.select(
            F.col("event_id").alias("id"),
            map_values("event_type", EVENT_SOURCE).cast("long").alias("ingestion_source_id"),
            F.col("ts").alias("received_at"),
            ip.alias("source_ip"),
            F.lit("syslog").alias("normalized_type"),
            F.concat(F.lit('{"sourceIp":"'), ip, F.lit('","message":"'), msg, F.lit('"}')).alias("payload"),
        )

    @functools.cached_property
    def users(self) -> DataFrame:
        s = self.table("supplier")
        return s.select(
            F.col("s_suppkey").alias("id"),
            F.concat(F.lit("user"), F.col("s_suppkey"), F.lit("@example.com")).alias("email"),
            F.col("s_name").alias("name"),
            _pick(schemas.USER_ROLES, F.col("s_nationkey") % 4).alias("role"),
            (F.col("s_acctbal") >= 0).alias("is_active"),
            _ts_plus("MINUTE", "s_suppkey", f"TIMESTAMP_NTZ'{USER_EPOCH}'").alias("created_at"),
        )

    @functools.cached_property
    def notifications(self) -> DataFrame:
        e = self.table("events")
        eid = F.col("event_id")
        return e.select(
            eid.alias("id"),
            (eid % self.n_users).alias("user_id"),
            map_values("event_type", NOTIFICATION_KIND, "system").alias("type"),
            F.concat(F.lit("Notice "), eid).alias("title"),
            F.col("event_type").alias("message"),
            F.when(eid % 3 != 0, _ts_plus("HOUR", "1", "ts")).alias("read_at"),
            F.col("ts").alias("created_at"),
        )

    @functools.cached_property
    def audit_logs(self) -> DataFrame:
        e = self.table("events")
        eid = F.col("event_id")
        entity = map_values("event_type", EVENT_ENTITY, "alert")
        verb = _pick(["created", "updated", "deleted"], eid % 3)
        target_type = F.when(eid % 9 != 0, entity)
        return e.select(
            eid.alias("id"),
            F.when(eid % 4 != 0, F.col("user_id") % self.n_users).alias("actor_id"),
            F.concat(entity, F.lit("."), verb).alias("action"),
            target_type.alias("target_type"),
            F.when(target_type.isNotNull(), F.concat(F.lit("tgt"), (eid * 7919).cast("string"))).alias("target_id"),
            F.when(eid % 6 != 0, self._source_ip()).alias("ip_address"),
            F.col("props").alias("metadata"),
            F.col("ts").alias("created_at"),
        )

    @functools.cached_property
    def iocs(self) -> DataFrame:
        p = self.table("pages").select("page_id", "url")
        host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
        both = p.select("page_id", F.lit("url").alias("type"), F.col("url").alias("value")).unionByName(
            p.select("page_id", F.lit("domain").alias("type"), host.alias("value")))
        g = both.groupBy("type", "value").agg(F.min("page_id").alias("p0"), F.max("page_id").alias("p1"))
        return g.select(
            F.concat(F.col("type"), F.lit(":"), F.col("value")).alias("id"),
            "type", "value",
            _pick(schemas.SEVERITIES, F.col("p0") % 5).alias("severity"),
            F.lit(None).cast("string").alias("threat_actor_id"),
            _ts_plus("HOUR", "p0", f"TIMESTAMP_NTZ'{IOC_EPOCH}'").alias("first_seen_at"),
            _ts_plus("HOUR", "p1", f"TIMESTAMP_NTZ'{IOC_EPOCH}'").alias("last_seen_at"),
            _ts_plus("HOUR", "p0", f"TIMESTAMP_NTZ'{IOC_EPOCH}'").alias("created_at"),
        )

    # -- telemetry ----------------------------------------------------------
    @functools.cached_property
    def syslog_lines(self) -> DataFrame:
        """Raw syslog text; every 10th line is garbage, PRI spans 0-199 so
        codes ≥ 192 exercise the ``unknown`` facility; some lines carry
        surrounding whitespace."""
        e = self.table("events")
        eid = F.col("event_id")
        msg = F.replace(_pick(schemas.SAMPLE_MESSAGES, eid % 6), F.lit("{ip}"), F.col("remote_address"))
        staged = (e.withColumn("remote_address", self._source_ip())
                  .withColumn("line", F.concat(F.lit("<"), eid % 200, F.lit(">Jan  5 10:22:01 host"),
                                               F.col("user_id"), F.lit(" "), msg)))
        raw = (F.when(eid % 10 == 9, F.concat(F.lit("garbled line "), eid))
               .when(eid % 10 == 3, F.concat(F.lit(" "), F.col("line"), F.lit("\t")))
               .otherwise(F.col("line")))
        return staged.select(eid.alias("line_id"), raw.alias("raw"), "remote_address",
                             F.col("ts").alias("received_at"))

    @functools.cached_property
    def http_requests(self) -> DataFrame:
        """Request metric samples: duration (ms), method label, status."""
        e = self.table("events")
        return e.select(
            F.col("event_id").alias("request_id"),
            F.col("ts"),
            F.col("event_type").alias("method"),
            (F.col("value") * 10).alias("duration_ms"),
            F.when(F.col("event_id") % 100 < 6, F.lit("500")).otherwise(F.lit("200")).alias("status"),
        )

    @functools.cached_property
    def ingestion_jobs(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.col("event_id").alias("job_id"),
            F.col("event_type").alias("queue"),
            F.col("ts").alias("enqueued_at"),
            _ts_plus("MILLISECOND", "event_id % 20000", "ts").alias("started_at"),
            (F.col("value") < 40).alias("succeeded"),
        )

    @functools.cached_property
    def counter_samples(self) -> DataFrame:
        """A monotone counter per series that wraps (resets) every 400 steps."""
        e = self.table("events")
        return e.select(
            F.concat(F.lit("worker-"), F.col("event_id") % 7).alias("series"),
            F.col("ts"),
            F.expr("CAST((event_id div 7) % 400 AS DOUBLE)").alias("value"),
        )

    @functools.cached_property
    def connection_deltas(self) -> DataFrame:
        """+1 on open, -1 on close (W-4 input)."""
        e = self.table("events")
        return e.select(
            F.col("event_type").alias("label"), F.col("ts"), F.col("event_id").alias("seq"),
            F.when(F.col("event_id") % 3 == 2, F.lit(-1)).otherwise(F.lit(1)).cast("long").alias("delta"),
        )

    @functools.cached_property
    def queue_gauges(self) -> DataFrame:
        """Gauge samples (waiting/active/delayed) per queue; some fields absent."""
        e = self.table("events")
        eid = F.col("event_id")
        return e.select(
            F.col("event_type").alias("queue"), F.col("ts"),
            F.when(eid % 4 != 0, (eid % 13).cast("double")).alias("waiting"),
            F.when(eid % 5 != 0, (eid % 3).cast("double")).alias("active"),
            F.when(eid % 6 != 0, (eid % 2).cast("double")).alias("delayed"),
        )

    @functools.cached_property
    def status_changes(self) -> DataFrame:
        """Incident patch log over every incident (ids are multiples of 50) and
        a fifth as many ids that do not exist,
        status from ``floor(event_id / 700) % 5`` so repeats occur."""
        e = self.table("events")
        eid = F.col("event_id")
        assign_set = eid % 4 == 0
        return e.select(
            eid.alias("change_id"),
            ((eid % F.greatest(F.floor(self.n_events / 40), F.lit(1))) * 50).alias("entity_id"),
            F.col("ts"),
            # null = field absent from this patch
            F.when(eid % 6 != 5, _pick(schemas.INCIDENT_STATUSES, F.expr("(event_id div 700) % 5"))).alias("status"),
            assign_set.alias("assigned_to_set"),
            F.when(assign_set & (eid % 8 != 4), F.col("user_id") % 100).alias("assigned_to_id"),
        )

    # -- change batches (inputs of the M-* operators) -------------------------
    @functools.cached_property
    def vuln_changes(self) -> DataFrame:
        """Two status patches per lineitem (the second always
        ``remediated``) plus patches for ids that do not exist."""
        li = self.table("lineitem")
        vid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        first = _pick(["remediated", "accepted_risk", "open"], F.col("l_suppkey") % 3)
        a = li.select(F.concat(vid, F.lit("#0")).alias("change_id"), vid.alias("entity_id"),
                      _ts_plus("DAY", "10", "l_shipdate").alias("ts"), first.alias("status"))
        b = li.select(F.concat(vid, F.lit("#1")).alias("change_id"), vid.alias("entity_id"),
                      _ts_plus("DAY", "20", "l_shipdate").alias("ts"), F.lit("remediated").alias("status"))
        c = li.where("l_returnflag = 'A'").select(
            F.concat(vid, F.lit("#x")).alias("change_id"), F.concat(vid, F.lit("-x")).alias("entity_id"),
            _ts_plus("DAY", "5", "l_shipdate").alias("ts"), F.lit("remediated").alias("status"))
        return a.unionByName(b).unionByName(c)

    @functools.cached_property
    def ioc_incoming(self) -> DataFrame:
        p = self.table("pages").select("page_id", "url")
        host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
        known = p.select(
            (F.col("page_id") * 10).alias("incoming_id"), F.lit("domain").alias("type"), host.alias("value"),
            F.lit(None).cast("string").alias("severity"))
        fresh = p.select(
            (F.col("page_id") * 10 + 1).alias("incoming_id"), F.lit("url").alias("type"),
            F.concat(F.col("url"), F.lit("#v2")).alias("value"), F.lit(None).cast("string").alias("severity"))
        ips = p.select(
            (F.col("page_id") * 10 + 2).alias("incoming_id"), F.lit("ip").alias("type"),
            F.concat(F.lit("203.0.113."), F.col("page_id") % 50).alias("value"),
            _pick(schemas.SEVERITIES, F.col("page_id") % 5).alias("severity"))
        return known.unionByName(fresh).unionByName(ips)

    @functools.cached_property
    def ioc_patches(self) -> DataFrame:
        p = self.table("pages")
        return p.select(F.col("page_id").alias("change_id"), F.concat(F.lit("url:"), F.col("url")).alias("entity_id"),
                        _ts_plus("HOUR", "page_id", "TIMESTAMP_NTZ'2024-02-01 00:00:00'").alias("ts"),
                        F.when(F.col("page_id") % 8 == 0, F.lit("critical")).alias("severity"))

    @functools.cached_property
    def mapping_patches(self) -> DataFrame:
        e = self.table("events")
        eid = F.col("event_id")
        ids = (F.when(eid % 3 == 0, F.array().cast("array<string>"))
               .when(eid % 3 == 1, F.array(F.lit("T1078"), F.lit("T1059"))))
        a = e.select(eid.alias("change_id"), eid.alias("entity_id"), "ts", ids.alias("mitre_technique_ids"))
        b = e.where("event_type = 'error'").select((eid + 1000000000).alias("change_id"), eid.alias("entity_id"),
                                          _ts_plus("HOUR", "1", "ts").alias("ts"),
                                          F.array(F.lit("T1566")).alias("mitre_technique_ids"))
        return a.unionByName(b)

    @functools.cached_property
    def incident_requests(self) -> DataFrame:
        e = self.table("events").where("event_type = 'error'")
        eid = F.col("event_id")
        return e.select(
            eid.alias("request_id"), F.concat(F.lit("Case "), eid).alias("title"),
            F.when(F.col("value") >= 10, F.concat(F.lit("Opened after "), F.col("event_type"))).alias("description"),
            map_values("event_type", EVENT_SEVERITY, "info").alias("severity"),
            F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("assigned_to_id"),
            (F.col("user_id") % self.n_users).alias("author_id"),
            F.array(eid + 1, eid + 2, eid + 98, eid + 100000000).alias("alert_ids"), "ts")

    @functools.cached_property
    def source_toggles(self) -> DataFrame:
        e = self.table("events").where("event_type = 'signup'")
        return e.select(F.col("event_id").alias("change_id"),
                        (F.col("event_id") % 7 + 1).cast("long").alias("entity_id"), "ts",
                        (F.col("value") < 50).alias("is_active"))

    @functools.cached_property
    def timeline_notes(self) -> DataFrame:
        e = self.table("events").where("event_type = 'click'")
        return e.select(F.col("event_id").alias("note_id"), ((F.col("event_id") % F.greatest(F.floor(self.n_events / 45), F.lit(1))) * 50)
                        .alias("incident_id"),
                        (F.col("user_id") % self.n_users).alias("author_id"),
                        F.concat(F.lit("Note "), F.col("event_id")).alias("message"), "ts")

    @functools.cached_property
    def alert_creates(self) -> DataFrame:
        e = self.table("events")
        eid = F.col("event_id")
        title = (F.when(eid % 90 == 0, F.lit("")).when(eid % 45 == 0, F.repeat(F.lit("x"), 201))
                 .otherwise(F.concat(F.lit("Manual alert "), eid)))
        sev = (F.when(F.col("event_type") == "view", F.lit("informational"))
               .when(F.col("event_type") == "click", F.lit(None).cast("string"))
               .otherwise(map_values("event_type", EVENT_SEVERITY)))
        return e.select(eid.alias("id"), title.alias("title"), F.lit(None).cast("string").alias("description"),
                        sev.alias("severity"), F.lit(None).cast("string").alias("status"),
                        F.when(eid % 2 == 0, F.col("ts")).alias("created_at"))

    @functools.cached_property
    def alert_changes(self) -> DataFrame:
        """Alert patches: every event patches alert ``event_id·7`` modulo the
        number of alerts with some of title / severity / status /
        assignee; an assignee patch clears the field one time in two."""
        e = self.table("events")
        eid = F.col("event_id")
        a_set = eid % 6 == 1
        return e.select(
            eid.alias("change_id"), ((eid * 7) % self.n_events).alias("entity_id"), "ts",
            F.when(eid % 3 == 0, F.concat(F.lit("Retitled "), eid)).alias("title"),
            F.when(eid % 4 == 0, _pick(schemas.SEVERITIES, eid % 5)).alias("severity"),
            F.when(eid % 2 == 0, _pick(schemas.ALERT_STATUSES, F.expr("(event_id div 2) % 4"))).alias("status"),
            a_set.alias("assigned_to_set"),
            F.when(a_set & (eid % 12 != 1), F.col("user_id") % self.n_users).alias("assigned_to_id"),
        )

    @functools.cached_property
    def live_changes(self) -> DataFrame:
        """ST-12: everything that happens to alerts and incidents, as one log:
        their creation, their patches, and the deletion of the alerts whose
        event has a value of 150 or more."""
        a, i, e = self.alerts, self.incidents, self.table("events")
        none = F.lit(None).cast("string")

        def rows(df, entity, op, ident, ts, severity=none, status=none):
            return df.select(F.lit(entity).alias("entity"), ident.cast("string").alias("id"), F.lit(op).alias("op"),
                             F.concat(F.lit(op), F.lit(":"), F.col("id" if op != "patch" else "change_id")).alias("change_id"),
                             ts.alias("ts"), severity.alias("severity"), status.alias("status"))
        parts = [
            rows(a, "alert", "create", F.col("id"), F.col("created_at"), F.col("severity"), F.col("status")),
            rows(self.alert_changes, "alert", "patch", F.col("entity_id"), F.col("ts"), F.col("severity"), F.col("status")),
            rows(e.where("value >= 150").withColumn("id", F.col("event_id")), "alert", "delete", F.col("id"),
                 _ts_plus("DAY", "1", "ts")),
            rows(i, "incident", "create", F.col("id"), F.col("created_at"), F.col("severity"), F.col("status")),
            rows(self.status_changes, "incident", "patch", F.col("entity_id"), F.col("ts"), status=F.col("status"))]
        return functools.reduce(DataFrame.unionByName, parts)


def domain(spark: SparkSession, sf_dir: str) -> Domain:
    return Domain(spark, sf_dir)
