"""ST-1/ST-14 (stream = batch, replay), ST-12 live views, ST-10 stream."""

import os

from pyspark.sql import functions as F

from helpers import ts, write_text
from nightjar.streaming.alerting import sustained_breach_stream
from nightjar.streaming.ingest import ingest_batch, ingest_stream, read_ingest_output
from nightjar.streaming.live import alerts_heatmap_stream

LINES = [
    "<38>Jan  5 10:22:01 web sshd[1]: Failed password for root from 203.0.113.20 port 51515 ssh2",
    "<13>Jan  5 10:22:02 web cron[2]: (root) CMD (/usr/local/bin/backup.sh)",
    "<13>Jan  5 10:22:03 web sudo: deploy : TTY=pts/1 ; COMMAND=/usr/bin/systemctl restart nginx",
    "not syslog at all",
    "<13>Jan  5 10:22:04 web kernel: possible ransomware behavior",
]


def sources(spark):
    return spark.createDataFrame([(2, "syslog", "syslog", True)], "id long, name string, type string, "
                                                                  "is_active boolean")


def test_ingest_stream_equals_batch_and_quarantines(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    write_text(src, "a.log", "\n".join(LINES[:3]) + "\n")
    write_text(src, "b.log", "\n".join(LINES[3:]) + "\n")
    out = os.path.join(scratch, "out")
    q = ingest_stream(spark, src, out, sources(spark), checkpoint=os.path.join(scratch, "ckpt"),
                      max_files_per_trigger=1)
    q.awaitTermination(120)
    raw = read_ingest_output(spark, out, "raw_events")
    alerts = read_ingest_output(spark, out, "alerts")
    assert raw.count() == 4  # every parsable line is landed, benign ones included
    assert sorted(r.severity for r in alerts.collect()) == ["critical", "low", "medium"]
    assert read_ingest_output(spark, out, "quarantine").count() == 1
    m = read_ingest_output(spark, out, "alert_mitre_mappings")
    assert sorted(r.mitre_technique_id for r in m.collect()) == ["T1110", "T1486", "T1548"]


def test_replayed_batch_gives_same_tables(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    write_text(src, "a.log", "\n".join(LINES) + "\n")
    lines = spark.read.text(src).select(
        F.col("value").alias("raw"), F.lit(None).cast("string").alias("remote_address"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("received_at"),
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"))
    out = os.path.join(scratch, "out")
    ingest_batch(lines, 0, sources(spark), out, 2)
    first = sorted((r.id, r.title) for r in read_ingest_output(spark, out, "alerts").collect())
    ingest_batch(lines, 0, sources(spark), out, 2)  # the same micro-batch again
    again = sorted((r.id, r.title) for r in read_ingest_output(spark, out, "alerts").collect())
    assert first == again and len(first) == 3


def test_live_heatmap_stream(spark, scratch):
    src = os.path.join(scratch, "alerts")
    spark.createDataFrame([(1, ts("2024-03-03 05:10:00")), (2, ts("2024-03-03 05:50:00"))],
                          "id long, created_at timestamp_ntz").write.parquet(src)
    stream = spark.readStream.schema("id long, created_at timestamp_ntz").parquet(src)
    q = (alerts_heatmap_stream(stream).writeStream.outputMode("complete").format("memory")
         .queryName("heat_test").option("checkpointLocation", os.path.join(scratch, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    rows = spark.sql("SELECT * FROM heat_test").collect()
    assert [(r.day_of_week, r.hour, r["count"]) for r in rows] == [(0, 5, 2)]


def _breach_events(spark, scratch, batches, name, step=15, hold=300):
    """Evaluations fed file by file, one micro-batch each."""
    schema = "rule string, ts timestamp_ntz, cond boolean"
    src = os.path.join(scratch, "evals-" + name)
    os.makedirs(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    q = (sustained_breach_stream(stream, ["rule"], "ts", "cond", hold, step).writeStream.outputMode("append")
         .format("memory").queryName(name).option("checkpointLocation", os.path.join(scratch, "ck-" + name))
         .start())
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(src, f"{i:03d}"))
        q.processAllAvailable()
    q.stop()
    return sorted((r.series, r.event, r.at.replace(tzinfo=None)) for r in spark.sql(f"SELECT * FROM {name}").collect())


def _batch_events(spark, rows):
    import datetime as dt

    from nightjar.operators import slo
    ev = spark.createDataFrame(rows, "rule string, ts timestamp_ntz, cond boolean")
    out = []
    for r in slo.sustained_breach(ev, ["rule"], "ts", "cond", "5 minutes").where("firing").collect():
        out += [(r.rule, "firing", r.fired_at), (r.rule, "resolved", r.ended_at + dt.timedelta(seconds=15))]
    return sorted(out)


def test_sustained_breach_stream(spark, scratch):
    """Out of order, repeated, missing and too late evaluations, and a series
    that falls silent: the stream's transitions are the batch form's."""
    import datetime as dt
    import random
    base = ts("2024-01-01 00:00:00")

    def at(i):
        return base + dt.timedelta(seconds=15 * i)
    rows = [("plain", at(i), True) for i in range(22)] + [("plain", at(22), False)]
    rows += [("gap", at(0), True), ("gap", at(1), True), ("gap", at(40), True)]          # never held
    rows += [("hole", at(i), True) for i in range(60) if i != 30]                        # two runs
    rows += [("silent", at(i), True) for i in range(25)]                                 # ends without a false
    rows += [("twice", at(i), True) for i in range(25)] + [("twice", at(11), True)]
    rnd = random.Random(1)
    # arrival: by time, shuffled within the watermark's minute
    rows.sort(key=lambda r: r[1] + dt.timedelta(seconds=rnd.randint(0, 50)))
    batches = [rows[i:i + 25] for i in range(0, len(rows), 25)]
    late = ("plain", at(3), False)
    batches.append([late, ("clock", at(400), False)])
    batches.append([("clock", at(500), False), ("plain", at(5), True)])
    got = _breach_events(spark, scratch, batches, "breach_all")
    assert [e for e in got if e[1] != "too_late"] == _batch_events(spark, rows)
    assert [e for e in got if e[1] == "too_late"] == [("plain", "too_late", at(3)), ("plain", "too_late", at(5))]
    assert {s for s, e, _ in got if e == "firing"} == {"plain", "hole", "silent", "twice"}


def _run_memory(df, name, scratch, mode):
    q = (df.writeStream.outputMode(mode).format("memory").queryName(name)
         .option("checkpointLocation", os.path.join(scratch, "ck-" + name)).trigger(availableNow=True).start())
    q.awaitTermination(120)


def test_stream_windows_equal_batch(spark, scratch):
    """ST-4/ST-7 streams (watermark, append) give the batch windows."""
    import datetime as dt

    from nightjar.operators import slo
    from nightjar.streaming.live import error_ratio_stream, quantiles_stream
    base = ts("2024-01-01 00:00:00")
    rows = [(base + dt.timedelta(seconds=20 * i), "500" if i % 7 == 0 else "200", float(i % 13)) for i in range(60)]
    # a far-future row moves the watermark past every window of interest
    rows.append((base + dt.timedelta(days=1), "200", 0.0))
    src = os.path.join(scratch, "req")
    spark.createDataFrame(rows, "ts timestamp_ntz, status string, v double").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp_ntz, status string, v double").parquet(src)
    _run_memory(error_ratio_stream(stream), "err_s", scratch, "append")
    _run_memory(quantiles_stream(stream, "ts", "v"), "q_s", scratch, "append")
    batch = spark.read.parquet(src).where(F.col("ts") < base + dt.timedelta(hours=1))
    b_err = {(r.window_start, r.requests, r.errors) for r in slo.error_ratio(batch, "ts").collect()}
    s_err = {(r.window_start, r.requests, r.errors) for r in spark.sql("SELECT * FROM err_s").collect()
             if r.window_start < base + dt.timedelta(hours=1)}
    assert b_err == s_err and len(b_err) > 0
    b_q = {(r.window_start, r.p50) for r in slo.windowed_quantiles(batch, "ts", "v").collect()}
    s_q = {(r.window_start, r.p50) for r in spark.sql("SELECT * FROM q_s").collect()
           if r.window_start < base + dt.timedelta(hours=1)}
    assert b_q == s_q


def test_live_trend_and_summary(spark, scratch):
    from nightjar.streaming.live import alerts_trend_stream, summary_stream
    src = os.path.join(scratch, "al")
    spark.createDataFrame([(1, "critical", "open", ts("2024-03-01 05:00:00")),
                           (2, "info", "resolved", ts("2024-03-01 06:00:00")),
                           (3, "high", "open", ts("2024-03-02 01:00:00"))],
                          "id long, severity string, status string, created_at timestamp_ntz").write.parquet(src)
    stream = spark.readStream.schema("id long, severity string, status string, created_at timestamp_ntz").parquet(src)
    _run_memory(alerts_trend_stream(stream), "trend_s", scratch, "update")
    _run_memory(summary_stream(stream), "sum_s", scratch, "complete")
    trend = {r.date: (r.critical, r.info, r.high, r.total) for r in spark.sql("SELECT * FROM trend_s").collect()}
    assert trend == {"2024-03-01": (1, 1, 0, 2), "2024-03-02": (0, 0, 1, 1)}
    s = spark.sql("SELECT * FROM sum_s").first()
    assert (s.alerts_total, s.alerts_open, s.alerts_critical) == (3, 2, 1)


def test_group_notifications_stream_equals_batch(spark, scratch):
    import datetime as dt

    from nightjar.operators import slo
    from nightjar.streaming.alerting import group_notifications_stream
    base = ts("2024-01-01 00:00:00")
    episodes = [("A", base, base + dt.timedelta(minutes=20)), ("A", base + dt.timedelta(minutes=2), None),
                ("B", base + dt.timedelta(minutes=7), base + dt.timedelta(minutes=8))]
    horizon = base + dt.timedelta(hours=9)
    src = os.path.join(scratch, "fire")
    ev = [(n, f, 1) for n, f, _ in episodes] + [(n, r, -1) for n, _, r in episodes if r is not None]
    spark.createDataFrame(ev, "alertname string, ts timestamp_ntz, delta int").write.parquet(src + "/a")
    # a later event of another name moves the watermark to the horizon
    spark.createDataFrame([("zz", horizon, 1)], "alertname string, ts timestamp_ntz, delta int").write.parquet(
        src + "/b")
    stream = (spark.readStream.schema("alertname string, ts timestamp_ntz, delta int").option("maxFilesPerTrigger", 1)
              .parquet(src + "/*"))
    q = (group_notifications_stream(stream, "alertname", "ts", "delta", watermark="0 seconds").writeStream
         .outputMode("append").format("memory").queryName("notify_s")
         .option("checkpointLocation", os.path.join(scratch, "ck")).trigger(processingTime="1 second").start())
    try:
        q.processAllAvailable()
        import time
        time.sleep(3)
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r.alertname, r.sent_at.replace(tzinfo=None), r.alerts, r.reason)
                 for r in spark.sql("SELECT * FROM notify_s WHERE alertname <> 'zz'").collect())
    batch = spark.createDataFrame(episodes, "alertname string, fired_at timestamp_ntz, resolved_at timestamp_ntz")
    want = sorted((r.alertname, r.sent_at, r.alerts, r.reason)
                  for r in slo.group_notifications(batch, horizon).collect())
    assert got == want and len(want) >= 4


def test_unknown_source_is_quarantined(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    write_text(src, "a.log", "\n".join(LINES) + "\n")
    out = os.path.join(scratch, "out")
    lines = spark.read.text(src).select(
        F.col("value").alias("raw"), F.lit(None).cast("string").alias("remote_address"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("received_at"),
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"))
    ingest_batch(lines, 0, sources(spark), out, source_id=99)
    q = read_ingest_output(spark, out, "quarantine")
    reasons = sorted(r.reason for r in q.collect())
    assert reasons == ["unknown ingestion_source_id"] * 4 + ["unparsable syslog line"]
    assert read_ingest_output(spark, out, "alerts").count() == 0


def test_redelivered_events_are_dropped(spark, scratch):
    """ST-14: an at-least-once source (keys from topic/partition/offset)
    redelivers a line; the stream keeps one copy."""
    src = os.path.join(scratch, "kafka_like")
    rows = [(LINES[0], None, ts("2024-01-05 10:22:01"), "topic-0-17"),
            (LINES[0], None, ts("2024-01-05 10:22:01"), "topic-0-17"),
            (LINES[2], None, ts("2024-01-05 10:22:03"), "topic-0-18")]
    spark.createDataFrame(rows, "raw string, remote_address string, received_at timestamp_ntz, event_key string"
                          ).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("raw string, remote_address string, received_at timestamp_ntz, "
                                     "event_key string").parquet(src)
    out = os.path.join(scratch, "out")
    q = ingest_stream(spark, None, out, sources(spark), checkpoint=os.path.join(scratch, "ck"), lines=stream,
                      dedupe_keys=["event_key"])
    q.awaitTermination(120)
    assert read_ingest_output(spark, out, "raw_events").count() == 2
    assert sorted(r.severity for r in read_ingest_output(spark, out, "alerts").collect()) == ["low", "medium"]


def test_upload_stream(spark, scratch):
    import json

    from nightjar.streaming.ingest import ingest_upload_stream
    src = os.path.join(scratch, "uploads")
    os.makedirs(src)
    write_text(src, "a.json", json.dumps([{"ip": "10.0.0.9", "message": "Failed password for root"},
                                          {"message": "all good"}]))
    write_text(src, "obj.json", json.dumps({"message": "x"}))
    write_text(src, "big.json", json.dumps([{"i": i} for i in range(1001)]))
    write_text(src, "notes.txt", "ignored")
    srcs = spark.createDataFrame([(3, "File Upload", "file_upload", True)], "id long, name string, type string, "
                                                                            "is_active boolean")
    out = os.path.join(scratch, "out")
    q = ingest_upload_stream(spark, src, out, srcs, 3, checkpoint=os.path.join(scratch, "ck"), max_rows=1000)
    q.awaitTermination(120)
    raw = read_ingest_output(spark, out, "raw_events")
    assert sorted(r.source_ip or "" for r in raw.collect()) == ["", "10.0.0.9"]
    (a,) = read_ingest_output(spark, out, "alerts").collect()
    assert a.severity == "medium" and a.description.endswith("from 10.0.0.9.")
    reasons = sorted(r.reason for r in read_ingest_output(spark, out, "quarantine").collect())
    assert reasons == ["File contains 1001 rows; max is 1000", "JSON file must contain an array of records"]


def test_csv_uploads_as_a_stream_equal_the_batch(spark, scratch):
    """JSON and CSV files of different column orders, as they arrive."""
    from nightjar.sources.upload import read_upload
    from nightjar.streaming.ingest import ingest_upload_stream, read_ingest_output
    src, out = os.path.join(scratch, "up"), os.path.join(scratch, "out")
    os.makedirs(src)
    write_text(src, "a.csv", "ip,message\n10.0.0.1,Failed password for root\n10.0.0.2,two\n")
    write_text(src, "b.CSV", 'message,ip\n"x, y",10.0.0.3\n')
    write_text(src, "c.json", '[{"ip":"10.0.0.4","message":"json"}]')
    write_text(src, "d.csv", "only,a,header\n")
    sources = spark.createDataFrame([(4, "up")], "id long, name string")
    for more in (None, "e.csv"):
        if more:
            write_text(src, more, "src_ip\n10.0.0.5\n")
        ingest_upload_stream(spark, src, out, sources, 4, checkpoint=os.path.join(scratch, "ck")).awaitTermination(120)
    got = sorted((r.source_ip, r.payload) for r in read_ingest_output(spark, out, "raw_events").collect())
    csv = [p for p in ("a.csv", "b.CSV", "d.csv", "e.csv")]
    want = [r for p in csv for r in read_upload(spark, os.path.join(src, p), 4, "2024-01-01 00:00:00")[0].collect()]
    assert got == sorted([(r.source_ip, r.payload) for r in want] + [("10.0.0.4", '{"ip":"10.0.0.4","message":"json"}')])
    assert read_ingest_output(spark, out, "alerts").count() == 1


def test_signed_deltas_equal_the_batch(spark, scratch):
    """Creates, patches and deletes in any order, some twice, over several
    micro-batches: the deltas' counts are those of the final rows."""
    import datetime as dt
    import random

    from nightjar.streaming.live import live_summary, live_trend, signed_deltas, visible_rows
    schema = "entity string, id string, op string, change_id string, ts timestamp_ntz, severity string, status string"
    rnd, base, rows = random.Random(2), ts("2024-01-01 00:00:00"), []
    for n in range(40):
        entity = "alert" if n % 3 else "incident"
        at = base + dt.timedelta(hours=7 * n)
        rows.append((entity, str(n), "create", f"c{n}", at, rnd.choice(["critical", "high"]), "open"))
        for k in range(rnd.randint(0, 3)):
            rows.append((entity, str(n), "patch", f"p{n}-{k}", at + dt.timedelta(minutes=rnd.randint(1, 3)),
                         rnd.choice([None, "low", "medium"]), rnd.choice([None, "resolved", "investigating"])))
        if rnd.random() < 0.3:
            rows.append((entity, str(n), "delete", f"d{n}", at + dt.timedelta(days=1), None, None))
    rows += [("alert", "unknown", "patch", "px", base, "low", "open")] + rnd.sample(rows, 15)
    rnd.shuffle(rows)
    src, table = os.path.join(scratch, "log"), os.path.join(scratch, "deltas")
    os.makedirs(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    for i in range(0, len(rows), 30):
        spark.createDataFrame(rows[i:i + 30], schema).coalesce(1).write.parquet(os.path.join(src, f"{i:04d}"))
    q = (signed_deltas(stream).writeStream.outputMode("append").format("parquet").option("path", table)
         .option("checkpointLocation", os.path.join(scratch, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(180)
    deltas, final = spark.read.parquet(table), visible_rows(spark.createDataFrame(rows, schema))
    assert deltas.where("delta < 0").count() > 0
    assert live_summary(deltas).collect() == live_summary(final).collect()
    assert sorted(live_trend(deltas).collect()) == sorted(live_trend(final).collect())
    counted = spark.readStream.schema(deltas.schema).parquet(table)
    _run_memory(live_summary(counted), "live_sum", scratch, "complete")
    assert spark.sql("SELECT * FROM live_sum").collect() == live_summary(final).collect()
