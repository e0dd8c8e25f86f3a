"""SC-1/SC-2 syslog parsing, DET-1..4 rules (reference unit cases)."""

import json

from pyspark.sql import functions as F

from nightjar.functions.scalars import js_trim
from nightjar.functions.syslog import parse_syslog, syslog_payload, with_parsed_syslog
from nightjar.operators.detect import detect


def parse(spark, lines):
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "i int, raw string")
    out = with_parsed_syslog(df).orderBy("i").collect()
    col_form = df.select("i", parse_syslog("raw").alias("p")).orderBy("i").collect()
    assert [r.parsed for r in out] == [r.p for r in col_form]
    return [r.parsed for r in out]


def test_syslog_examples(spark):
    a, b, c, d = parse(spark, [
        "<34>Oct 11 22:14:15 mymachine su: 'su root' failed for lonvick on /dev/pts/8",
        "<38>Jan  5 10:22:01 webserver sshd[1234]: Failed password for root from 10.0.0.5 port 51422 ssh2",
        "this is not syslog", "garbage"])
    assert (a.facility, a.severity, a.host, a.tag, a.message) == (
        "auth", "critical", "mymachine", "su", "'su root' failed for lonvick on /dev/pts/8")
    assert (b.facility, b.severity, b.host, b.tag) == ("auth", "informational", "webserver", "sshd[1234]")
    assert "Failed password for root" in b.message
    assert c is None and d is None


def test_syslog_edge_cases(spark):
    hi, trimmed, multi, empty_msg = parse(spark, [
        "<199>Jan  5 10:22:01 h t: m", "\n\t <13>Jan  5 10:22:01 h app : hello \n",
        "<13>Jan  5 10:22:01 h t: line1\nline2", "<13>Jan  5 10:22:01 h t:"])
    assert hi.facility == "unknown" and hi.severity == "debug"
    assert (trimmed.facility, trimmed.severity, trimmed.tag, trimmed.message) == ("user", "notice", "app", "hello")
    assert multi is None
    assert empty_msg.message == ""


def test_js_trim_strips_newlines(spark):
    r = spark.createDataFrame([("\n\t x \r\n",)], "s string").select(js_trim("s").alias("t")).first()
    assert r.t == "x"


def test_normalized_payload(spark):
    raw = "<38>Jan  5 10:22:01 webserver sshd[1234]: Failed password for root"
    df = spark.createDataFrame([(raw,)], "raw string")
    p = json.loads(with_parsed_syslog(df).select(syslog_payload("parsed", "raw").alias("j")).first().j)
    assert list(p) == ["facility", "severity", "host", "tag", "message", "raw"] and p["raw"] == raw


def run_rules(spark, cases):
    df = spark.createDataFrame(cases, "payload string, source_ip string")
    return [r.detection for r in detect(df).collect()]


def test_rules(spark):
    fail, mal, sudo, benign, both = run_rules(spark, [
        ('{"message":"Failed password for root from 10.0.0.5"}', "10.0.0.5"),
        ('{"message":"ransomware payload executed"}', None),
        ('{"message":"sudo: root : TTY=pts/0 ; COMMAND=/usr/bin/systemctl restart nginx"}', ""),
        ('{"message":"system startup complete"}', None),
        ('{"message":"invalid user ransomware"}', None)])
    assert (fail.severity, fail.mitre_technique_ids) == ("medium", ["T1110"])
    assert fail.description == "Ingested telemetry matched a failed-authentication pattern from 10.0.0.5."
    assert (mal.severity, mal.mitre_technique_ids) == ("critical", ["T1486"])
    assert (sudo.severity, sudo.mitre_technique_ids) == ("low", ["T1548"])
    assert sudo.description == "Ingested telemetry recorded a sudo command execution."  # '' ip = absent
    assert benign is None
    assert both.title == "Failed authentication attempt detected"  # first match wins


def test_rules_match_json_text_case_insensitively(spark):
    (hit,) = run_rules(spark, [('{"MSG":"AUTHENTICATION FAILURE"}', None)])
    assert hit.severity == "medium"
    (key_hit,) = run_rules(spark, [('{"trojan":1}', None)])  # keys are part of the text
    assert key_hit.severity == "critical"


def test_scalar_helpers(spark):
    from pyspark.sql import functions as F

    from nightjar.functions import scalars as sc
    df = spark.createDataFrame([('{"level":"warn","n":3}', ["a", "b"], 150, None, "x")],
                               "j string, arr array<string>, v int, a string, b string")
    r = df.select(sc.json_field("j", "$.level").alias("lv"), sc.variant_field("j", "$.n", "int").alias("n"),
                  sc.array_size("arr").alias("sz"), sc.has_item("arr", "b").alias("hb"),
                  sc.clamp("v", 0, 100).alias("c"), sc.nullish_coalesce("a", "b").alias("nc"),
                  sc.map_items("arr", F.upper).alias("up"), sc.payload_text("j").alias("pt")).first()
    assert (r.lv, r.n, r.sz, r.hb, r.c, r.nc, r.up) == ("warn", 3, 2, True, 100, "x", ["A", "B"])
    assert r.pt == '{"level":"warn","n":3}'


def test_process_ingestion_end_to_end(spark):
    """FIXTURES A4: benign → landed, freshness set, no alert; failed login →
    landed + medium alert + T1110 mapping + feed message."""
    import datetime as dt
    import json as js

    from nightjar.sinks.ingest import process_ingestion
    sources = spark.createDataFrame([(1, "syslog", "syslog", True, None, None)],
                                    "id long, name string, type string, is_active boolean, config string, "
                                    "last_ingested_at timestamp_ntz")
    t1, t2 = dt.datetime(2024, 1, 5, 10, 0, 0), dt.datetime(2024, 1, 5, 10, 0, 5)
    events = spark.createDataFrame(
        [(1, t1, None, "syslog", '{"message":"cron[441]: (root) CMD (/usr/local/bin/backup.sh)"}', "k1"),
         (1, t2, "203.0.113.20", "syslog",
          '{"message":"sshd[1234]: Failed password for root from 203.0.113.20 port 51515 ssh2"}', "k2")],
        "ingestion_source_id long, received_at timestamp_ntz, source_ip string, normalized_type string, "
        "payload string, event_key string")
    out = process_ingestion(events, sources, key_col="event_key")
    assert out["raw_events"].count() == 2
    (a,) = out["alerts"].collect()
    assert (a.severity, a.status, a.title) == ("medium", "open", "Failed authentication attempt detected")
    assert a.description.endswith("from 203.0.113.20.")
    assert [r.mitre_technique_id for r in out["alert_mitre_mappings"].collect()] == ["T1110"]
    assert out["sources"].first().last_ingested_at == t2
    msg = js.loads(out["feed"].first().message)
    assert msg["type"] == "alert.created" and msg["data"]["id"] == a.id
    again = process_ingestion(events, sources, key_col="event_key")["alerts"].first()
    assert again.id == a.id  # deterministic ids under replay


def test_js_trim_unicode_spaces(spark):
    df = spark.createDataFrame([("  ﻿x y　 ",)], "s string")
    assert df.select(js_trim("s").alias("t")).first().t == "x y"
