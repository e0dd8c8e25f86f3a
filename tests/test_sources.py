"""SRC-1 CSV records, SRC-2 JSON uploads, SRC-7 JSON logs, SRC-8 source ip, SRC-9 row guard."""

import json
import os

from pyspark.sql import functions as F

from helpers import write_text
from nightjar.sources.files import read_csv_events, read_json_events, read_json_logs
from nightjar.sources.upload import guard_max_rows, read_upload, source_ip_from_json


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_csv_basic(spark, scratch):
    p = write_text(scratch, "a.csv", "ip,user,status\n10.0.0.1,root,failed\n10.0.0.2,admin,success\n")
    out = rows(read_csv_events(spark, p))
    assert out == [{"ip": "10.0.0.1", "user": "root", "status": "failed"},
                   {"ip": "10.0.0.2", "user": "admin", "status": "success"}]


def test_csv_quoted_commas_and_quotes(spark, scratch):
    p = write_text(scratch, "b.csv", 'title,note\n"Alert, high priority","contains, a comma"\n')
    assert rows(read_csv_events(spark, p)) == [{"title": "Alert, high priority", "note": "contains, a comma"}]
    p = write_text(scratch, "c.csv", 'title\n"She said ""hello"""\n')
    assert rows(read_csv_events(spark, p)) == [{"title": 'She said "hello"'}]


def test_csv_crlf_and_header_only(spark, scratch):
    p = write_text(scratch, "d.csv", "a,b\r\n1,2\r\n3,4\r\n")
    assert rows(read_csv_events(spark, p)) == [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}]
    p = write_text(scratch, "e.csv", "a,b,c\n")
    assert read_csv_events(spark, p).count() == 0


def test_csv_short_extra_blank_and_multiline(spark, scratch):
    p = write_text(scratch, "f.csv", 'a,b,c\n1\n\n4,5,6,7\n"x\ny",2,3\n')
    out = rows(read_csv_events(spark, p))
    assert out == [{"a": "1", "b": "", "c": ""}, {"a": "4", "b": "5", "c": "6"}, {"a": "x\ny", "b": "2", "c": "3"}]


def test_csv_duplicate_header_keeps_last(spark, scratch):
    p = write_text(scratch, "g.csv", "a,b,a\n1,2,3\n")
    assert rows(read_csv_events(spark, p)) == [{"a": "3", "b": "2"}]


def test_json_upload_array_object_malformed(spark, scratch):
    write_text(scratch, "ok.json", json.dumps([{"ip": "10.0.0.9", "message": "x"}]))
    write_text(scratch, "obj.json", json.dumps({"ip": "10.0.0.9"}))
    write_text(scratch, "bad.json", "{not valid json")
    out = read_json_events(spark, scratch)
    got = {r.file.rsplit("/", 1)[1]: (r.record, r.rejected) for r in out.collect()}
    assert got["ok.json"][1] is False and json.loads(got["ok.json"][0]) == {"ip": "10.0.0.9", "message": "x"}
    assert got["obj.json"] == (None, True)
    assert got["bad.json"] == (None, True)


def test_json_upload_keeps_key_order_and_nulls(spark, scratch):
    write_text(scratch, "k.JSON", '[{"b": 1, "a": null, "c": "z"}]')
    rec = read_json_events(spark, scratch).collect()[0].record
    assert rec.replace(" ", "") == '{"b":1,"a":null,"c":"z"}'


def test_source_ip_resolution(spark):
    cases = [
        ('{"ip": "1.1.1.1", "sourceIp": "2.2.2.2"}', "1.1.1.1"),
        ('{"ip": null, "sourceIp": "2.2.2.2"}', "2.2.2.2"),
        ('{"ip": "", "sourceIp": "2.2.2.2"}', ""),
        ('{"ip": 5, "sourceIp": "2.2.2.2"}', None),
        ('{"src_ip": "3.3.3.3"}', "3.3.3.3"),
        ('{"source_ip": "4.4.4.4", "src_ip": "3.3.3.3"}', "4.4.4.4"),
        ('{"message": "x"}', None),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, rec string")
    got = {r.i: r.ip for r in df.select("i", source_ip_from_json("rec").alias("ip")).collect()}
    assert [got[i] for i in range(len(cases))] == [e for _, e in cases]


def test_max_rows_guard(spark):
    recs = spark.range(1001).select(F.lit("big.csv").alias("file"), "id").unionByName(
        spark.range(2).select(F.lit("small.csv").alias("file"), "id"))
    accepted, rejected = guard_max_rows(recs, max_rows=1000)
    assert accepted.count() == 2
    r = rejected.collect()
    assert len(r) == 1 and r[0].file == "big.csv" and "max is 1000" in r[0].reason


def test_json_logs(spark, scratch):
    write_text(scratch, "log.txt", '{"level":"error","msg":"boom","container":"/api","service":"api"}\n'
                                   '{"level":"info","msg":"ok","container":"/worker","service":"worker"}\n')
    out = read_json_logs(spark, scratch, service="api").collect()
    assert [(r.level, r.msg, r.container) for r in out] == [("error", "boom", "api")]


def test_mitre_dimension_and_upsert(spark):
    from nightjar.sources.tables import mitre_dimension, upsert_techniques
    dim = mitre_dimension(spark)
    t1110 = dim.where("id = 'T1110'").first()
    assert (t1110.name, t1110.tactic, t1110.url) == ("Brute Force", "Credential Access",
                                                     "https://attack.mitre.org/techniques/T1110/")
    upd = spark.createDataFrame([("T1110", "Brute Force v2", "Credential Access"), ("T9001", "New", "Impact")],
                                "id string, name string, tactic string")
    out = {r.id: r.name for r in upsert_techniques(dim, upd).collect()}
    assert len(out) == 34 and out["T1110"] == "Brute Force v2" and out["T9001"] == "New"


def test_ensure_sources_get_or_create(spark):
    from nightjar.sources.tables import ensure_sources
    existing = spark.createDataFrame([(1, "Syslog listener", "syslog")], "id long, name string, type string")
    wanted = spark.createDataFrame([(7, "dup syslog", "syslog"), (9, "upload b", "file_upload"),
                                    (8, "upload a", "file_upload")], "id long, name string, type string")
    out = sorted((r.id, r.type) for r in ensure_sources(existing, wanted).collect())
    assert out == [(1, "syslog"), (8, "file_upload")]
    again = ensure_sources(ensure_sources(existing, wanted), wanted)
    assert again.count() == 2  # never duplicates


def test_audit_sink_appends(spark, scratch):
    import os

    from helpers import ts
    from nightjar.sinks.ingest import audit_sink
    rows = spark.createDataFrame([("a1", "alert.created", ts("2024-01-01 10:00:00"))],
                                 "id string, action string, created_at timestamp_ntz")
    path = os.path.join(scratch, "audit")
    audit_sink(rows, path)
    audit_sink(rows, path)
    assert spark.read.parquet(path).count() == 2


def test_daily_report(spark, scratch):
    import glob
    import os

    from helpers import mk
    from nightjar.operators.analytics import daily_report
    a = mk(spark, "alerts", [dict(id=1, title="x", severity="high", status="open", created_at="2024-01-15 03:00:00",
                                  updated_at="2024-01-15 03:00:00"),
                             dict(id=2, title="y", severity="low", status="open", created_at="2024-01-16 03:00:00",
                                  updated_at="2024-01-16 03:00:00")])
    e = lambda n: mk(spark, n, [])
    s = daily_report(a, e("incidents"), e("vulnerabilities"), e("assets"), "2024-01-15",
                     os.path.join(scratch, "rep")).first()
    assert s.alerts_total == 1 and s.day == "2024-01-15"
    text = "".join(open(p).read() for p in glob.glob(os.path.join(scratch, "rep", "alerts", "part-*.csv")))
    assert text.count("\n") == 2 and ",x," in text


def test_upload_flow(spark, scratch):
    import os

    from nightjar.sources.upload import read_upload
    csvp = write_text(scratch, "up.csv", "ip,message\n10.0.0.1,Failed password for root\n10.0.0.2,hello\n")
    ev, rej = read_upload(spark, csvp, 3, "2024-01-01 00:00:00")
    out = sorted((r.source_ip, r.payload, r.normalized_type) for r in ev.collect())
    assert out[0] == ("10.0.0.1", '{"ip":"10.0.0.1","message":"Failed password for root"}', "file_upload")
    assert len(out) == 2 and rej.count() == 0
    jdir = os.path.join(scratch, "json")
    os.makedirs(jdir)
    write_text(jdir, "one.json", '[{"sourceIp": "1.2.3.4", "message": "x"}]')
    write_text(jdir, "obj.json", '{"message": "x"}')
    write_text(jdir, "bad.json", "{not valid json")
    write_text(jdir, "big.json", json.dumps([{"i": i} for i in range(1001)]))
    ev, rej = read_upload(spark, jdir + "/*.json", 3, "2024-01-01 00:00:00")
    assert ev.count() == 1002 and rej.count() == 2  # no bound unless one is given
    ev, rej = read_upload(spark, jdir + "/*.json", 3, "2024-01-01 00:00:00", max_rows=1000)
    assert [(r.source_ip, r.payload) for r in ev.collect()] == [("1.2.3.4", '{"sourceIp":"1.2.3.4","message":"x"}')]
    reasons = {r.file.rsplit("/", 1)[1]: r.reason for r in rej.collect()}
    assert reasons == {"obj.json": "JSON file must contain an array of records",
                       "bad.json": "Failed to parse JSON file",
                       "big.json": "File contains 1001 rows; max is 1000"}


def test_csv_lone_quoted_empty_dropped_but_commas_kept(spark, scratch):
    p = write_text(scratch, "h.csv", 'a,b,c\n""\n,,\n"",x,\n')
    assert rows(read_csv_events(spark, p)) == [{"a": "", "b": "", "c": ""}, {"a": "", "b": "x", "c": ""}]


def _reference_csv(text):
    """The reference's grammar, character by character."""
    rows, row, field, quoted, i = [], [], "", False, 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1:i + 2] == '"':
                field, i = field + '"', i + 1
            elif c == '"':
                quoted = False
            else:
                field += c
        elif c == '"':
            quoted = True
        elif c == ",":
            row.append(field)
            field = ""
        elif c in "\r\n":
            if c == "\r" and text[i + 1:i + 2] == "\n":
                i += 1
            rows.append(row + [field])
            row, field = [], ""
        else:
            field += c
        i += 1
    if field or row:
        rows.append(row + [field])
    if not rows:
        return []
    return [{name: (r[i] if i < len(r) else "") for i, name in enumerate(rows[0])}
            for r in rows[1:] if len(r) > 1 or r[0] != ""]


def test_csv_files_by_their_own_header(spark):
    import json
    import random

    from nightjar.sources.files import read_csv_files
    texts = ["ip,user,status\n10.0.0.1,root,failed\n10.0.0.2,admin,success\n", "user,ip\nroot,10.0.0.9\n",
             'title,note\n"Alert, high priority","contains, a comma"\n', 'title\n"She said ""hello"""\n',
             "a,b\r\n1,2\r\n3,4\r\n", "a,b,c\n", "", "a,b\n1\n1,2,3\n\n,,\n", 'a,b\n"",\n""\n', "a,a,b\n1,2,3",
             'a,b\n"x\ny",2\rz,"open to the end\n1,2', 'a\nx"y,z"w\n', "\na,b\n1,2\n", "é,b\n👍,\n"]
    rnd = random.Random(3)
    texts += ["h,i\n" + "".join(rnd.choice(['"', ",", "\n", "\r", "a", " "]) for _ in range(rnd.randint(1, 14)))
              for _ in range(300)]
    long = "h,i\n" + '"' + "x,\n" * 200_000 + '",1\n' + "y," * 100_000 + "\n"
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate([*texts, long, None])], "file string, value string")
    got = {}
    for r in read_csv_files(df).orderBy("ordinal").collect():
        got.setdefault(int(r.file), []).append(json.loads(r.record, object_pairs_hook=list))
    for i, t in enumerate([*texts, long]):
        want = [list(x.items()) for x in _reference_csv(t)]
        assert [[tuple(p) for p in x] for x in got.get(i, [])] == want, (t[:80], got.get(i), want)
    assert len(texts) + 1 not in got


def test_csv_folder_with_different_columns(spark, scratch):
    """Cells are named by their own file's header, not by the first file's."""
    write_text(scratch, "a.csv", "ip,message\n10.0.0.1,one\n10.0.0.2,two\n")
    write_text(scratch, "b.csv", "message,severity,source_ip\nthree,high,10.0.0.3\n")
    events, rejected = read_upload(spark, scratch, 4, "2024-01-01 00:00:00", max_rows=2)
    got = sorted((r.source_ip, r.payload) for r in events.collect())
    assert got == [("10.0.0.1", '{"ip":"10.0.0.1","message":"one"}'), ("10.0.0.2", '{"ip":"10.0.0.2","message":"two"}'),
                   ("10.0.0.3", '{"message":"three","severity":"high","source_ip":"10.0.0.3"}')]
    assert rejected.count() == 0
    _, rejected = read_upload(spark, scratch, 4, "2024-01-01 00:00:00", max_rows=1)
    assert [r.reason for r in rejected.collect()] == ["File contains 2 rows; max is 1"]


def test_json_array_over_several_lines(spark, scratch):
    """A pretty-printed upload is one array, not one line."""
    write_text(scratch, "p.json", '[\n  {"ip": "10.0.0.1"},\n  {"ip": "10.0.0.2"}\n]\n')
    events, rejected = read_upload(spark, os.path.join(scratch, "p.json"), 4, "2024-01-01 00:00:00")
    assert sorted(r.source_ip for r in events.collect()) == ["10.0.0.1", "10.0.0.2"] and rejected.count() == 0
