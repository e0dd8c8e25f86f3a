"""Rows that earlier versions dropped, capped or changed without a word."""

import os

import pytest
from pyspark.sql import functions as F

from nightjar.functions.syslog import parse_syslog
from nightjar.operators import changes as ch
from nightjar.operators import listing as li
from nightjar.operators import slo
from nightjar.plans.jobs import analytics_job, incident_changes_job
from nightjar.sinks.export import export_json
from nightjar.sinks.ingest import land
from nightjar.sinks.snapshots import read_latest, versions, write_version
from nightjar.sources.tables import scan
from nightjar.streaming.ingest import ingest_stream, with_event_key
from helpers import mk, ts, write_text

AS_OF = "2024-05-01 00:00:00"


def _requests(spark, n=3):
    rows = [(i, f"Case {i}", "high", None, None, 1, [], ts("2024-04-01 00:00:00")) for i in range(n)]
    return spark.createDataFrame(rows, "request_id long, title string, severity string, status string, "
                                       "assigned_to_id string, author_id string, alert_ids array<string>, "
                                       "ts timestamp_ntz")


def test_open_incidents_keeps_the_table(spark):
    """Numeric ids, and a column that new incidents do not have."""
    old = mk(spark, "incidents", [dict(id=i, title="t", description="d", severity="low", status="open",
                                       created_at="2024-01-01 00:00:00", updated_at="2024-01-01 00:00:00")
                                  for i in range(20)])
    alerts = mk(spark, "alerts", [dict(id="a", title="x", severity="low", status="open",
                                       created_at="2024-01-01 00:00:00", updated_at="2024-01-01 00:00:00")])
    timeline = mk(spark, "incident_timeline_events", [dict(id="n", incident_id=1, event_type="note", message="m",
                                                           created_at="2024-01-01 00:00:00")])
    out = ch.open_incidents(old, alerts, timeline, _requests(spark), AS_OF)
    assert out["incidents"].count() == 23 and out["timeline"].count() == 4
    assert out["incidents"].where("description = 'd'").count() == 20


def test_patch_of_a_missing_column_is_an_error(spark):
    old = mk(spark, "incidents", [dict(id="1", title="t", severity="low", status="open",
                                       created_at="2024-01-01 00:00:00", updated_at="2024-01-01 00:00:00")])
    patch = spark.createDataFrame([(1, "1", ts("2024-02-01 00:00:00"), "new")],
                                  "change_id long, entity_id string, ts timestamp_ntz, description string")
    assert ch.patch_incidents(old, patch)["snapshot"].first().description == "new"
    with pytest.raises(ValueError, match="description"):
        ch.patch_incidents(old.drop("description"), patch)


def test_names_defaults_and_audits(spark):
    new = spark.createDataFrame([(1, "CVE", "high")], "request_id long, title string, severity string")
    out = ch.create_entities(new, "vulnerabilities", AS_OF)
    assert out["audit"].first().action == "vulnerability.created"
    assert out["rows"].first().discovered_at == ts(AS_OF)
    snap = mk(spark, "vulnerabilities", [dict(id="v", title="t", severity="low", status="open",
                                              discovered_at=AS_OF, created_at=AS_OF)])
    patch = spark.createDataFrame([(1, "v", ts(AS_OF), "remediated"), (2, "gone", ts(AS_OF), "open")],
                                  "change_id long, entity_id string, ts timestamp_ntz, status string")
    audit = ch.patch_vulnerabilities(snap, patch)["audit"].collect()
    assert [(r.action, r.target_id, r.metadata) for r in audit] == [
        ("vulnerability.updated", "v", '{"status":"remediated"}')]


def test_timeline_authors_actors_and_techniques_on_delete(spark):
    gone = spark.createDataFrame([("u1",)], "id string")
    line = mk(spark, "incident_timeline_events", [
        dict(id="1", incident_id="i", author_id="u1", event_type="note", message="m", created_at=AS_OF),
        dict(id="2", incident_id="i", author_id=None, event_type="note", message="m", created_at=AS_OF)])
    rest = [mk(spark, e, []) for e in ("alerts", "incidents", "notifications", "audit_logs")]
    out = ch.delete_users(mk(spark, "users", []), *rest, gone, timeline=line)["incident_timeline_events"]
    assert sorted((r.id, r.author_id) for r in out.collect()) == [("1", None), ("2", None)]
    iocs = mk(spark, "iocs", [dict(id="x", type="ip", value="v", severity="low", threat_actor_id="u1",
                                   first_seen_at=AS_OF, last_seen_at=AS_OF, created_at=AS_OF)])
    assert ch.delete_threat_actors(mk(spark, "threat_actors", []), iocs, gone)["iocs"].first().threat_actor_id is None


@pytest.mark.parametrize("order", ["asc", "desc"])
@pytest.mark.parametrize("sort_by", ["severity", "created_at"])
def test_keyset_walks_the_whole_order(spark, order, sort_by):
    times = [None, "2024-01-01 00:00:00", "2024-01-02 00:00:00"]
    df = spark.createDataFrame([(i, [None, "info", "critical", "low", "medium", "high"][i % 6],
                                 None if times[i % 3] is None else ts(times[i % 3])) for i in range(23)],
                               "id long, severity string, created_at timestamp_ntz")
    want = [r.id for r in li.ordered(df, sort_by, order).collect()]
    got, after = [], None
    while True:
        rows = li.keyset_page(df, 4, sort_by, after, order=order).collect()
        got += [r.id for r in rows]
        if len(rows) < 4:
            break
        after = (rows[-1][sort_by], rows[-1].id)
    assert got == want
    assert li.page(df, 10**6, 25, sort_by, order).collect() == []  # far beyond the last row


def test_syslog_line_with_control_character(spark):
    df = spark.createDataFrame([("<34>Oct 11 22:14:15 host su: a\u0001b end",)], "raw string")
    assert df.select(parse_syslog("raw").alias("p")).first().p.message == "a\u0001b end"


def test_json_export_keeps_arrays(spark, scratch):
    df = spark.createDataFrame([("1", ["a", "b"], ts(AS_OF))], "id string, tags array<string>, created_at timestamp_ntz")
    export_json(df, f"{scratch}/out")
    text = spark.read.text(f"{scratch}/out").first().value
    assert '"tags":["a","b"]' in text


def test_equal_events_have_ids_of_their_own(spark):
    df = spark.createDataFrame([("s", ts(AS_OF), None, "syslog", "p")] * 3,
                               "ingestion_source_id string, received_at timestamp_ntz, source_ip string, "
                               "normalized_type string, payload string")
    first = {r.id for r in land(df).collect()}
    assert len(first) == 3 and first == {r.id for r in land(df.repartition(3)).collect()}


def test_event_keys_do_not_depend_on_packing(spark, scratch):
    for i in range(6):
        write_text(scratch, f"f{i}.log", "".join(f"line {j % 3}\n" for j in range(5)))
    lines = spark.read.text(scratch).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file_path"),
                                            F.col("_metadata.file_block_start").alias("block_start"))
    keys = {r.event_key for r in with_event_key(lines).collect()}
    assert len(keys) == 30
    assert keys == {r.event_key for r in with_event_key(lines.repartition(7)).collect()}


def test_counter_deltas_cross_window_edges(spark):
    df = spark.createDataFrame([("c", ts("2024-01-01 00:50:00"), 10.0), ("c", ts("2024-01-01 01:10:00"), 110.0),
                                ("c", ts("2024-01-01 05:10:00"), 5.0)], "series string, ts timestamp_ntz, value double")
    out = [r.increase for r in slo.counter_increase(df).orderBy("window_start").collect()]
    assert out == [0.0, 100.0, 5.0]


def test_quantiles_of_a_dense_window(spark):
    df = spark.range(20_000).select(F.lit(ts("2024-01-01 00:00:07")).alias("ts"), (F.col("id") % 4000).alias("v"))
    one = F.col("window_start") == F.lit(ts("2024-01-01 00:00:00"))
    exact = slo.windowed_quantiles(df, "ts", "v", method="exact").where(one).first()
    assert (exact.n, exact.p50) == (20_000, 1999.5)
    h = slo.windowed_quantiles(df, "ts", "v").where(one).first()
    assert h.n == 20_000 and h.p50 == pytest.approx(2000, abs=2) and h.p99 == pytest.approx(4933.29, abs=1)
    plan = slo.windowed_quantiles(df, "ts", "v", method="exact")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate")  # counted before the copies are made


def test_ingest_change_and_analytics_jobs_compose(spark, scratch):
    """Stream in, patch incidents twice (one batch retried), read it all back."""
    wh, logs = f"{scratch}/wh", f"{scratch}/logs"
    os.makedirs(logs)
    write_text(logs, "a.log", "".join(
        f"<38>Jan  5 10:22:0{i} web sshd[1]: Failed password for root from 10.0.0.{i}\n" for i in range(5))
        + "<38>Jan  5 10:22:09 web cron: fine\n")
    sources = mk(spark, "ingestion_sources", [dict(id=2, name="s", type="syslog", is_active=True, created_at=AS_OF)])
    ingest_stream(spark, logs, wh, sources, 2, checkpoint=f"{scratch}/ck").awaitTermination(120)
    assert scan(spark, f"{wh}/raw_events", "raw_events").count() == 6
    alerts = scan(spark, f"{wh}/alerts", "alerts")
    assert alerts.count() == 5 and dict(alerts.dtypes)["id"] == "string"
    assert any(n.startswith("received_date=") for n in os.listdir(f"{wh}/raw_events/batch=0"))
    incidents = mk(spark, "incidents", [dict(id=str(i), title="t", severity="low", status="open", created_at=AS_OF,
                                             updated_at=AS_OF) for i in range(3)])
    write_version(incidents, f"{wh}/incidents")
    for e, rows in (("vulnerabilities", []), ("assets", []), ("ingestion_sources", None)):
        (sources if rows is None else mk(spark, e, rows)).write.parquet(f"{wh}/{e}")

    def patch(i, status):
        return spark.createDataFrame([(i, "1", ts(f"2024-05-0{i} 00:00:00"), status)],
                                     "change_id long, entity_id string, ts timestamp_ntz, status string")
    first = incident_changes_job(spark, wh, patch(2, "resolved"), "b1")

    def derived(batch):
        return {t: sorted(map(str, spark.read.parquet(f"{wh}/{t}/batch={batch}").collect()))
                for t in ("incident_timeline_events", "audit_logs")}
    before = derived("b1")
    assert len(before["incident_timeline_events"]) == 1
    incident_changes_job(spark, wh, patch(3, "open"), "b2")
    assert incident_changes_job(spark, wh, patch(2, "resolved"), "b1") == first and derived("b1") == before
    assert versions(spark, f"{wh}/incidents") == [0, 1, 2]
    latest = {r.id: r.status for r in read_latest(spark, f"{wh}/incidents").collect()}
    assert latest == {"0": "open", "1": "open", "2": "open"}
    paths = analytics_job(spark, wh, f"{scratch}/out", "2024-05-10 00:00:00")
    summary = spark.read.parquet(paths["dashboard_summary"]).first().asDict()
    assert 3 in summary.values() and 5 in summary.values()


def test_job_recovers_between_any_two_writes(spark, scratch, monkeypatch):
    wh = f"{scratch}/wh"
    write_version(mk(spark, "incidents", [dict(id="1", title="t", severity="low", status="open", created_at=AS_OF,
                                               updated_at=AS_OF)]), f"{wh}/incidents")
    p = spark.createDataFrame([(1, "1", ts("2024-05-02 00:00:00"), "resolved")],
                              "change_id long, entity_id string, ts timestamp_ntz, status string")
    import nightjar.sinks.snapshots as snapshots
    real = snapshots.write_version

    def dies(df, path, *a, **k):
        if path.endswith("/incidents"):
            raise OSError("lost")
        return real(df, path, *a, **k)
    monkeypatch.setattr(snapshots, "write_version", dies)
    with pytest.raises(OSError):
        incident_changes_job(spark, wh, p, "b")
    monkeypatch.setattr(snapshots, "write_version", real)
    assert incident_changes_job(spark, wh, p, "b") == {"incidents_version": 1}
    assert read_latest(spark, f"{wh}/incidents").first().status == "resolved"
    assert spark.read.parquet(f"{wh}/incident_timeline_events/batch=b").count() == 1


def test_labels_and_first_per_key(spark):
    from nightjar.functions.scalars import humanize
    df = spark.createDataFrame([("false_positive", 2), ("false_positive", 1), ("x", 3)], "k string, n int")
    assert {r[0] for r in df.select(humanize("k")).collect()} == {"false positive", "x"}
    assert sorted((r.k, r.n) for r in ch.dedupe(df, ["k"], "n").collect()) == [("false_positive", 1), ("x", 3)]


def _warehouse(spark, wh):
    rows = {
        "incidents": mk(spark, "incidents", [dict(id="1", title="t", severity="low", status="open", created_at=AS_OF,
                                                  updated_at=AS_OF)]),
        "alerts": mk(spark, "alerts", [dict(id=str(i), title="a", severity="low", status="open", created_at=AS_OF,
                                            updated_at=AS_OF, incident_id="1" if i < 2 else None) for i in range(4)]),
        "incident_timeline_events": mk(spark, "incident_timeline_events", [
            dict(id="n", incident_id="1", event_type="note", message="m", created_at=AS_OF)])}
    for t, df in rows.items():
        write_version(df, f"{wh}/{t}")
    return list(rows)


def _seen(spark, wh, tables):
    from nightjar.sinks.snapshots import read_committed
    return {t: sorted(map(str, read_committed(spark, wh, t).collect())) for t in tables}


def _killed_at_every_write(spark, scratch, monkeypatch, job, kind):
    """Run the job dying at its first, second ... write until it gets through:
    readers see the old tables until the commit, and then all new ones."""
    import nightjar.sinks.snapshots as snapshots
    real = snapshots.write_version
    whole = f"{scratch}/{kind}-whole"
    tables = _warehouse(spark, whole)
    job(whole)
    want = _seen(spark, whole, tables)
    broken = f"{scratch}/{kind}-broken"
    _warehouse(spark, broken)
    old = _seen(spark, broken, tables)
    for k in range(1, 9):
        count = {"n": 0}

        def dies(df, path, *a, k=k, count=count, **kw):
            count["n"] += 1
            if count["n"] == k:
                df.write.mode("overwrite").parquet(f"{path}/v=half")  # what a lost driver leaves
                raise OSError("lost")
            return real(df, path, *a, **kw)
        monkeypatch.setattr(snapshots, "write_version", dies)
        try:
            first = job(broken)
            break
        except OSError:
            assert _seen(spark, broken, tables) == old, k
    monkeypatch.setattr(snapshots, "write_version", real)
    assert k > 3 and _seen(spark, broken, tables) == want != old
    assert job(broken) == first and _seen(spark, broken, tables) == want
    return whole, broken


def test_opening_incidents_is_one_transaction(spark, scratch, monkeypatch):
    from nightjar.plans.jobs import open_incidents_job
    req = spark.createDataFrame(
        [("r1", "Case", "what happened", "high", None, None, "7", ["2", "3", "404"], ts("2024-05-02 00:00:00"))],
        "request_id string, title string, description string, severity string, status string, assigned_to_id string, "
        "author_id string, alert_ids array<string>, ts timestamp_ntz")
    whole, broken = _killed_at_every_write(
        spark, scratch, monkeypatch, lambda wh: open_incidents_job(spark, wh, req, "b", AS_OF), "open")
    for wh in (whole, broken):
        new = {r.id: r for r in scan(spark, f"{wh}/incidents", "incidents").collect() if r.title == "Case"}
        (ident, row), = new.items()
        assert (row.description, row.status, row.severity) == ("what happened", "open", "high")
        linked = {r.id for r in scan(spark, f"{wh}/alerts", "alerts").where(F.col("incident_id") == ident).collect()}
        assert linked == {"2", "3"}
        assert spark.read.parquet(f"{wh}/audit_logs/batch=b").count() == 1


def test_deleting_incidents_is_one_transaction(spark, scratch, monkeypatch):
    from nightjar.plans.jobs import delete_job
    gone = spark.createDataFrame([("1",), ("404",)], "id string")
    whole, broken = _killed_at_every_write(
        spark, scratch, monkeypatch, lambda wh: delete_job(spark, wh, "incidents", gone, "d", AS_OF), "delete")
    for wh in (whole, broken):
        assert scan(spark, f"{wh}/incidents", "incidents").count() == 0
        assert scan(spark, f"{wh}/incident_timeline_events", "incident_timeline_events").count() == 0
        assert scan(spark, f"{wh}/alerts", "alerts").where("incident_id is not null").count() == 0
        assert [r.target_id for r in spark.read.parquet(f"{wh}/deletion_audit/batch=d").collect()] == ["1"]


def test_batches_follow_each_other(spark, scratch):
    """A batch reads what the one before committed, whichever job made it."""
    from nightjar.plans.jobs import delete_job, open_incidents_job
    wh = f"{scratch}/wh"
    _warehouse(spark, wh)
    p = spark.createDataFrame([(1, "1", ts("2024-05-02 00:00:00"), "resolved")],
                              "change_id long, entity_id string, ts timestamp_ntz, status string")
    assert incident_changes_job(spark, wh, p, "p1") == {"incidents_version": 1}
    req = spark.createDataFrame([("r", "Case", "low", None, "7", ["2"], ts("2024-05-02 00:00:00"))],
                                "request_id string, title string, severity string, assigned_to_id string, "
                                "author_id string, alert_ids array<string>, ts timestamp_ntz")
    open_incidents_job(spark, wh, req, "o1", AS_OF)
    out = {r.title: r.status for r in scan(spark, f"{wh}/incidents", "incidents").collect()}
    assert out == {"t": "resolved", "Case": "open"}
    delete_job(spark, wh, "incidents", spark.createDataFrame([("1",)], "id string"), "x1", AS_OF)
    assert [r.title for r in scan(spark, f"{wh}/incidents", "incidents").collect()] == ["Case"]


def test_audit_sink_of_a_retried_batch(spark, scratch):
    from nightjar.sinks.ingest import audit_sink
    rows = mk(spark, "audit_logs", [dict(id=str(i), action="a", created_at=AS_OF) for i in range(3)])
    for batch in ("b1", "b1", "b2"):
        audit_sink(rows, f"{scratch}/audit", batch)
    assert spark.read.parquet(f"{scratch}/audit").groupBy("id").count().where("count != 2").count() == 0


def test_deletion_walks_the_catalogue(spark):
    """A deleted parent's children go with what refers to them."""
    from nightjar import schemas
    monkey = [*schemas.FOREIGN_KEYS, ("grand", "event_id", "raw_events", "cascade"), ("loose", "g_id", "grand", "set null")]
    t = {"ingestion_sources": spark.createDataFrame([(1,), (2,)], "id long"),
         "raw_events": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id long, ingestion_source_id long"),
         "grand": spark.createDataFrame([(100, 10), (101, 11)], "id long, event_id long"),
         "loose": spark.createDataFrame([(7, 100), (8, 101), (9, None)], "id long, g_id long"),
         "users": spark.createDataFrame([(1,)], "id long")}
    before = schemas.FOREIGN_KEYS
    schemas.FOREIGN_KEYS = monkey
    try:
        out = ch.delete_entities(t, "ingestion_sources", spark.createDataFrame([(1,)], "id long"))
    finally:
        schemas.FOREIGN_KEYS = before
    assert set(out) == {"ingestion_sources", "raw_events", "grand", "loose"}
    assert sorted(r.id for r in out["raw_events"].collect()) == [11, 12]
    assert [r.id for r in out["grand"].collect()] == [101]
    assert sorted((r.id, r.g_id) for r in out["loose"].collect()) == [(7, None), (8, 101), (9, None)]


def test_conflicts_of_one_hot_key(spark):
    """The first request of a key is new, all others conflict, copies too."""
    incoming = spark.createDataFrame([(i, "ip", "same") for i in range(50)] + [(0, "ip", "same"), (60, "ip", None),
                                     (61, "url", "known"), (62, "url", "new")], "incoming_id long, type string, value string")
    existing = spark.createDataFrame([("url", "known")], "type string, value string")
    new, conflicts = ch.reject_existing(incoming, existing, ["type", "value"], "incoming_id")
    assert sorted(r.incoming_id for r in new.collect()) == [0, 60, 62]
    assert sorted(r.incoming_id for r in conflicts.collect()) == sorted([*range(50), 61])


def test_a_patch_rewrites_its_bucket_alone(spark, scratch):
    from nightjar.sinks.snapshots import rewrite_buckets, write_bucketed
    alerts = mk(spark, "alerts", [dict(id=f"a{i}", title="t", severity="low", status="open", created_at=AS_OF,
                                       updated_at=AS_OF) for i in range(200)])
    path = f"{scratch}/alerts"
    write_bucketed(alerts, path, buckets=16)

    def files():
        return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet"))
                for d in os.listdir(path) if d.startswith("bucket=")}
    before, read = files(), []
    patch = spark.createDataFrame([(1, "a7", ts("2024-05-02 00:00:00"), "resolved")],
                                  "change_id long, entity_id string, ts timestamp_ntz, status string")
    fields = ch.patch_fields(alerts, patch, "alerts")

    def change(rows):
        read.extend(rows.inputFiles())
        return ch.apply_patches(rows, patch, fields)["snapshot"]
    touched = rewrite_buckets(spark, path, patch.select(F.col("entity_id").alias("id")), change, buckets=16)
    after = files()
    assert len(touched) == 1 and {d for d in after if after[d] != before[d]} == {f"bucket={touched[0]}"}
    assert spark.read.parquet(path).where(F.col("bucket").isin(touched)).count() < 60
    want = ch.apply_patches(alerts, patch, fields)["snapshot"]
    got = spark.read.parquet(path).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert rewrite_buckets(spark, path, patch.where("false").select(F.col("entity_id").alias("id")), change) == []


def test_bucket_batches_survive_a_kill(spark, scratch, monkeypatch):
    """Killed before the staged rows are in place: a retry, or the next batch,
    puts them there; logs and rows are those of an undisturbed run."""
    from nightjar.plans.jobs import patch_job
    from nightjar.sinks import snapshots
    rows = mk(spark, "incidents", [dict(id=f"i{n}", title="t", severity="low", status="open", created_at=AS_OF,
                                        updated_at=AS_OF) for n in range(40)])

    def patch(n, ident, status, when):
        return spark.createDataFrame([(n, ident, ts(when), status), (n + 50, "nobody", ts(when), status)],
                                     "change_id long, entity_id string, ts timestamp_ntz, status string")
    first = patch(1, "i3", "resolved", "2024-05-02 00:00:00")
    second = patch(2, "i3", "open", "2024-05-03 00:00:00")

    def state(wh):
        logs = {t: sorted((r.batch, r.change_id) for r in spark.read.parquet(f"{wh}/{t}").collect())
                for t in ("incident_timeline_events", "rejected_incident_patches")}
        return sorted(map(str, scan(spark, f"{wh}/incidents", "incidents").collect())), logs

    def killed(*_):
        raise RuntimeError("killed")
    for how in ("plain", "retry", "next"):
        wh = f"{scratch}/{how}"
        snapshots.write_bucketed(rows, f"{wh}/incidents", buckets=8, files=2)
        if how != "plain":
            with monkeypatch.context() as m:
                m.setattr(snapshots, "_publish", killed)
                with pytest.raises(RuntimeError):
                    patch_job(spark, wh, "incidents", first, "b1", buckets=8)
            assert scan(spark, f"{wh}/incidents", "incidents").where("status = 'resolved'").count() == 0
        if how != "next":
            touched = patch_job(spark, wh, "incidents", first, "b1", buckets=8)
            assert scan(spark, f"{wh}/incidents", "incidents").where("status = 'resolved'").count() == 1
            assert 1 <= len(touched) <= 2
        patch_job(spark, wh, "incidents", second, "b2", buckets=8)
        after = state(wh)
        assert patch_job(spark, wh, "incidents", first, "b1", buckets=8) and state(wh) == after
        if how == "plain":
            want = after
            assert [c for _, c in want[1]["incident_timeline_events"]] == [1, 2]
            assert sorted(c for _, c in want[1]["rejected_incident_patches"]) == [51, 52]
        assert after == want, how


def test_a_bucket_without_rows_goes(spark, scratch):
    from nightjar.sinks.snapshots import read_bucketed, rewrite_buckets, write_bucketed
    rows = spark.createDataFrame([(f"x{n}", n) for n in range(30)], "id string, n int")
    path = f"{scratch}/t"
    write_bucketed(rows, path, buckets=4)
    gone = spark.read.parquet(path).where("bucket = 2").select("id")
    ids = [r.id for r in gone.collect()]
    assert ids and rewrite_buckets(spark, path, gone, lambda old: old.where("false"), buckets=4) == [2]
    left = [r.id for r in spark.read.parquet(path).collect()]
    assert sorted(left + ids) == sorted(f"x{n}" for n in range(30)) and not set(left) & set(ids)
    assert rewrite_buckets(spark, path, rows.select("id"), lambda old: old.where("false"), buckets=4) == [0, 1, 2, 3]
    assert read_bucketed(spark, path).columns == ["id", "n", "bucket"] and read_bucketed(spark, path).count() == 0
    assert rewrite_buckets(spark, path, rows.select("id"), lambda old: rows, buckets=4) == [0, 1, 2, 3]
    assert read_bucketed(spark, path).count() == 30
    assert read_bucketed(spark, scratch) is None


def test_pages_at_any_depth_equal_the_keyset_walk(spark, monkeypatch):
    """Ties, nulls and enum order; text ids and number ids; beyond the rows
    that a page may sort."""
    import random
    rnd = random.Random(2)
    monkeypatch.setattr(li, "MAX_OFFSET", 10)
    monkeypatch.setattr(li, "SORTED_ROWS", 6)
    monkeypatch.setattr(li, "RANGES", 4)
    rows = [dict(id=f"{rnd.choice(['same-long-prefix-', ''])}{i}", title=None if i % 9 == 0 else f"t{rnd.randint(0, 3)}",
                 severity=rnd.choice(["low", "high", "info"]), status="open",
                 created_at=ts(f"2024-01-0{rnd.randint(1, 3)} 00:00:00")) for i in range(70)]
    df = mk(spark, "alerts", rows)
    for sort_by, order in (("created_at", "desc"), ("severity", "asc"), ("title", "desc"), ("title", "asc")):
        whole = [r.id for r in li.ordered(df, sort_by, order).collect()]
        for n in (2, 4, 7, 10, 11):
            assert [r.id for r in li.page(df, n, 7, sort_by, order).collect()] == whole[7 * (n - 1):7 * n], (sort_by, n)
    numbers = spark.createDataFrame([(i * 3, rnd.random(), i % 2) for i in range(60)], "id long, score double, flag int")
    for sort_by in ("score", "flag", "id"):
        whole = [r.id for r in li.ordered(numbers, sort_by, "desc").collect()]
        assert [r.id for r in li.page(numbers, 5, 9, sort_by, "desc").collect()] == whole[36:45], sort_by


def test_csv_lines_are_one_file_in_order(spark, scratch):
    """One header, rows in order across the parts, once after a retry."""
    from nightjar.sinks.export import export_csv_lines
    rows = [dict(id=f"i{n:03d}", title='say "x", y' if n == 5 else f"t{n}", severity="low", status="open",
                 created_at=ts(f"2024-01-{1 + n % 28:02d} 00:00:00")) for n in range(60)]
    df = mk(spark, "alerts", rows).select("id", "title", "created_at").repartition(5)
    for _ in range(2):
        export_csv_lines(df, f"{scratch}/csv")
    parts = sorted(f for f in os.listdir(f"{scratch}/csv") if f.startswith("part-"))
    lines = "".join(open(f"{scratch}/csv/{f}").read() for f in parts).splitlines()
    want = sorted(rows, key=lambda r: (-r["created_at"].timestamp(), r["id"]))
    assert lines[0] == "id,title,created_at" and len(lines) == 61
    assert [x.split(",")[0] for x in lines[1:]] == [r["id"] for r in want]
    assert 'i005,"say ""x"", y",2024-01-06T00:00:00.000Z' in lines


def test_hunting_opens_only_days_that_may_match(spark, scratch):
    """Same rows as the scan; days without the text's trigrams are not read; a
    day that the side table does not know is."""
    path, side = f"{scratch}/raw", f"{scratch}/trigrams"
    rows = [dict(id=f"{d}-{i}", received_at=ts(f"2024-01-{d:02d} 0{i}:00:00"), payload="p",
                 source_ip=None if i == 4 else f"10.{d}.{i}.7") for d in range(1, 13) for i in range(6)]
    events = mk(spark, "raw_events", rows).withColumn("received_date", F.to_date("received_at"))
    events.where("received_date < '2024-01-12'").write.partitionBy("received_date").parquet(path)
    li.day_trigrams(spark.read.parquet(path)).write.parquet(side)
    events.where("received_date = '2024-01-12'").write.mode("append").partitionBy("received_date").parquet(path)
    landed, trigrams = spark.read.parquet(path), spark.read.parquet(side)
    for text in ("10.7.", ".7", "9.3.7", "nothing", "10.12.1", "0.1"):
        got = li.hunt_landed(landed, trigrams, text)
        want = li.hunt_raw_events(landed, source_ip=text)
        assert got["total"].first() == want["total"].first(), text
        assert [r.id for r in got["items"].collect()] == [r.id for r in want["items"].collect()], text
    days = li.matching_days(trigrams, "10.7.")
    assert [str(d) for d in days] == ["2024-01-07"] and li.matching_days(trigrams, ".7") is None
    items = li.hunt_landed(landed, trigrams, "10.7.")["items"]
    items.collect()
    scan_line = next(x for x in items._jdf.queryExecution().executedPlan().toString().splitlines()
                     if "PartitionFilters" in x)
    assert "received_date" in scan_line.split("PartitionFilters")[1].split("PushedFilters")[0]
