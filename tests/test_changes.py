"""M-1..M-13, W-2, W-3, J-8, J-9, J-11, F-11 (reference mutation cases)."""

from pyspark.sql import functions as F

from helpers import mk, ts
from nightjar.operators import changes as ch

AS_OF = ts("2024-05-01 00:00:00")


def incidents(spark, **kw):
    base = dict(id=1, title="Breach", severity="high", status="open", assigned_to_id=None,
                created_at="2024-01-01 00:00:00", updated_at="2024-01-01 00:00:00")
    base.update(kw)
    return mk(spark, "incidents", [base])


def patches(spark, rows):
    return spark.createDataFrame(
        [(i, e, ts(t), s, a_set, a) for i, e, t, s, a_set, a in rows],
        "change_id long, entity_id long, ts timestamp_ntz, status string, assigned_to_set boolean, "
        "assigned_to_id long")


def test_status_change_timeline_and_closed_at_once(spark):
    p = patches(spark, [(1, 1, "2024-02-01 00:00:00", "investigating", False, None),
                        (2, 1, "2024-02-02 00:00:00", "investigating", False, None),
                        (3, 1, "2024-02-03 00:00:00", "resolved", False, None),
                        (4, 1, "2024-02-04 00:00:00", "open", False, None),
                        (5, 1, "2024-02-05 00:00:00", "closed", False, None),
                        (6, 42, "2024-02-05 00:00:00", "closed", False, None)])
    out = ch.patch_incidents(incidents(spark), p, bucket_unit="day")
    snap = out["snapshot"].first()
    assert snap.status == "closed" and snap.closed_at == ts("2024-02-03 00:00:00")  # first close, never moved
    msgs = [r.message for r in out["timeline"].orderBy("created_at").collect()]
    assert msgs == ["Status changed from open to investigating", "Status changed from investigating to resolved",
                    "Status changed from resolved to open", "Status changed from open to closed"]
    assert [r.entity_id for r in out["unknown"].collect()] == [42]
    audit = [r.metadata for r in out["audit"].orderBy("created_at").collect()]
    assert audit[0] == '{"status":"investigating"}' and len(audit) == 5


def test_assignment_notification_only_on_real_change(spark):
    p = patches(spark, [(1, 1, "2024-02-01 00:00:00", None, True, 7),
                        (2, 1, "2024-02-02 00:00:00", None, True, 7),
                        (3, 1, "2024-02-03 00:00:00", None, True, None),
                        (4, 1, "2024-02-04 00:00:00", None, True, 8)])
    out = ch.patch_incidents(incidents(spark, assigned_to_id=3), p, bucket_unit="day")
    n = [(r.user_id, r.title, r.message) for r in out["notifications"].orderBy("created_at").collect()]
    assert n == [(7, "Incident assigned to you", "Breach"), (8, "Incident assigned to you", "Breach")]
    assert out["snapshot"].first().assigned_to_id == 8


def test_tri_state_clear_and_keep(spark):
    p = patches(spark, [(1, 1, "2024-02-01 00:00:00", "contained", True, None)])
    snap = ch.patch_incidents(incidents(spark, assigned_to_id=3), p)["snapshot"].first()
    assert snap.assigned_to_id is None and snap.status == "contained"
    p = patches(spark, [(1, 1, "2024-02-01 00:00:00", None, False, None)])
    snap = ch.patch_incidents(incidents(spark, assigned_to_id=3), p)["snapshot"].first()
    assert snap.assigned_to_id == 3 and snap.status == "open"


def test_carry_forward_across_buckets(spark):
    # the same sequence split over many hour buckets gives the same "before" values
    rows = [(i, 1, f"2024-02-{1 + i // 24:02d} {i % 24:02d}:00:00", ["investigating", "open"][i % 2], False, None)
            for i in range(60)]
    out = ch.patch_incidents(incidents(spark), patches(spark, rows), bucket_unit="hour")
    assert out["timeline"].count() == 60


def test_remediated_at_set_once(spark):
    v = mk(spark, "vulnerabilities", [dict(id="v1", title="t", severity="high", status="open",
                                           discovered_at="2024-01-01 00:00:00", created_at="2024-01-01 00:00:00")])
    p = spark.createDataFrame([("c1", "v1", ts("2024-02-01 00:00:00"), "remediated"),
                               ("c2", "v1", ts("2024-02-05 00:00:00"), "remediated")],
                              "change_id string, entity_id string, ts timestamp_ntz, status string")
    r = ch.patch_vulnerabilities(v, p)["snapshot"].first()
    assert r.status == "remediated" and r.remediated_at == ts("2024-02-01 00:00:00")


def test_ioc_default_conflict_and_bump(spark):
    iocs = mk(spark, "iocs", [dict(id="ip:1.1.1.1", type="ip", value="1.1.1.1", severity="high",
                                   first_seen_at="2024-01-01 00:00:00", last_seen_at="2024-01-01 00:00:00",
                                   created_at="2024-01-01 00:00:00")])
    inc = spark.createDataFrame([(1, "ip", "1.1.1.1", None), (2, "domain", "evil.example", None),
                                 (3, "domain", "evil.example", "low")],
                                "incoming_id long, type string, value string, severity string")
    out = ch.merge_iocs(iocs, inc, AS_OF)
    ins = out["inserted"].collect()
    assert [(r.type, r.value, r.severity) for r in ins] == [("domain", "evil.example", "medium")]
    # a repeated request of the batch is a conflict too, not dropped
    assert sorted((r.type, r.value, r.incoming_id) for r in out["conflicts"].collect()) == [
        ("domain", "evil.example", 3), ("ip", "1.1.1.1", 1)]
    assert [r.action for r in out["audit"].collect()] == ["ioc.created"]
    p = spark.createDataFrame([(1, "ip:1.1.1.1", ts("2024-03-01 00:00:00"), None)],
                              "change_id long, entity_id string, ts timestamp_ntz, severity string")
    r = ch.patch_iocs(iocs, p)["snapshot"].first()
    assert r.last_seen_at == ts("2024-03-01 00:00:00") and r.severity == "high"


def test_replace_mappings_as_set(spark):
    m = spark.createDataFrame([(1, "T1566"), (2, "T1110")], "alert_id long, mitre_technique_id string")
    p = spark.createDataFrame([(1, 1, ts("2024-01-01 00:00:00"), ["T1078", "T1059"]),
                               (2, 2, ts("2024-01-01 00:00:00"), None)],
                              "change_id long, entity_id long, ts timestamp_ntz, mitre_technique_ids array<string>")
    out = {(r.alert_id, r.mitre_technique_id) for r in ch.replace_mappings(m, p).collect()}
    assert out == {(1, "T1078"), (1, "T1059"), (2, "T1110")}
    p2 = spark.createDataFrame([(1, 1, ts("2024-01-01 00:00:00"), [])],
                               "change_id long, entity_id long, ts timestamp_ntz, mitre_technique_ids array<string>")
    assert {r.alert_id for r in ch.replace_mappings(m, p2).collect()} == {2}  # empty list clears


def test_open_incident_seed_note_and_links(spark):
    al = mk(spark, "alerts", [dict(id=5, title="a", severity="low", status="open", created_at="2024-01-01 00:00:00")])
    inc = mk(spark, "incidents", [])
    tl = mk(spark, "incident_timeline_events", [])
    req = spark.createDataFrame([(1, "Case", "high", None, None, 3, [5, 99], ts("2024-02-01 00:00:00"))],
                                "request_id long, title string, severity string, status string, "
                                "assigned_to_id long, author_id long, alert_ids array<long>, ts timestamp_ntz")
    out = ch.open_incidents(inc, al, tl, req, AS_OF)
    created = out["created"].first()
    assert created.status == "open"
    notes = out["notes"].collect()
    assert [(n.event_type, n.message) for n in notes] == [("note", "Incident opened")]
    assert out["alerts"].first().incident_id == created.id
    assert out["links"].count() == 1  # unknown alert 99 ignored


def test_deletes_cascade_and_set_null(spark):
    al = mk(spark, "alerts", [dict(id=1, title="a", severity="low", status="open", incident_id=10, asset_id=3,
                                   created_at="2024-01-01 00:00:00")])
    m = spark.createDataFrame([(1, "T1110")], "alert_id long, mitre_technique_id string")
    gone = spark.createDataFrame([(10,)], "id long")
    assert ch.delete_incidents(mk(spark, "incidents", []), al, mk(spark, "incident_timeline_events", []),
                               gone)["alerts"].first().incident_id is None
    assert ch.delete_alerts(al, m, spark.createDataFrame([(1,)], "id long"))["alert_mitre_mappings"].count() == 0


def test_mark_read_and_read_all(spark):
    n = mk(spark, "notifications", [
        dict(id=1, user_id=7, type="system", title="a", message="m", created_at="2024-01-01 00:00:00"),
        dict(id=2, user_id=7, type="system", title="b", message="m", created_at="2024-01-01 00:00:00",
             read_at="2024-01-02 00:00:00"),
        dict(id=3, user_id=8, type="system", title="c", message="m", created_at="2024-01-01 00:00:00")])
    one = {r.id: r.read_at for r in ch.mark_read(n, 7, spark.createDataFrame([(1,), (3,)], "id long"),
                                                  AS_OF).collect()}
    assert one == {1: AS_OF, 2: ts("2024-01-02 00:00:00"), 3: None}  # not someone else's row
    allr = {r.id: r.read_at for r in ch.mark_read(n, 7, None, AS_OF).collect()}
    assert allr == {1: AS_OF, 2: ts("2024-01-02 00:00:00"), 3: None}


def test_toggle_sources_audit(spark):
    s = spark.createDataFrame([(1, "demo", "demo_generator", False)], "id long, name string, type string, "
                                                                       "is_active boolean")
    t = spark.createDataFrame([(1, 1, ts("2024-01-01 00:00:00"), True), (2, 9, ts("2024-01-01 00:00:00"), True)],
                              "change_id long, entity_id long, ts timestamp_ntz, is_active boolean")
    out = ch.toggle_sources(s, t)
    assert out["snapshot"].first().is_active is True
    a = out["audit"].first()
    assert a.action == "ingestion_source.enabled" and a.metadata == '{"type":"demo_generator"}'
    assert [r.entity_id for r in out["unknown"].collect()] == [9]


def test_notes_only_for_existing_incidents(spark):
    inc = mk(spark, "incidents", [dict(id=1, title="i", severity="high", status="open",
                                       created_at="2024-01-01 00:00:00")])
    notes = spark.createDataFrame([(1, 1, 3, "hello", ts("2024-01-02 00:00:00")),
                                   (2, 2, 3, "lost", ts("2024-01-02 00:00:00"))],
                                  "note_id long, incident_id long, author_id long, message string, ts timestamp_ntz")
    out = ch.append_timeline_notes(mk(spark, "incident_timeline_events", []), inc, notes)
    assert [r.message for r in out["added"].collect()] == ["hello"]
    assert [r.note_id for r in out["rejected"].collect()] == [2]


def test_validate_and_creates(spark):
    c = spark.createDataFrame([(1, "ok", "high"), (2, "", "high"), (3, "x" * 201, "bogus"), (4, "t", None)],
                              "id long, title string, severity string")
    valid, rejected = ch.validate(c, "alerts")
    assert [r.id for r in valid.collect()] == [1]
    reasons = {r.id: r.reasons for r in rejected.collect()}
    assert reasons == {2: ["title: too short"], 3: ["severity: invalid value", "title: too long"],
                       4: ["severity: required"]}
    created = ch.apply_creates(valid, "alerts", AS_OF).first()
    assert created.status == "open" and created.created_at == AS_OF


def test_referential_split(spark):
    child = spark.createDataFrame([(1, 10), (2, None), (3, 99)], "id long, parent long")
    parent = spark.createDataFrame([(10,)], "id long")
    ok, bad = ch.referential_split(child, parent, "parent")
    assert sorted(r.id for r in ok.collect()) == [1, 2] and [r.id for r in bad.collect()] == [3]


def test_patch_alerts_notification_uses_new_title(spark):
    al = mk(spark, "alerts", [dict(id=1, title="Old", severity="low", status="open", assigned_to_id=3,
                                   created_at="2024-01-01 00:00:00", updated_at="2024-01-01 00:00:00")])
    ch_ = spark.createDataFrame(
        [(1, 1, ts("2024-02-01 00:00:00"), "New title", None, None, True, 9),
         (2, 1, ts("2024-02-02 00:00:00"), None, "high", "acknowledged", False, None),
         (3, 7, ts("2024-02-02 00:00:00"), None, "high", None, False, None)],
        "change_id long, entity_id long, ts timestamp_ntz, title string, severity string, status string, "
        "assigned_to_set boolean, assigned_to_id long")
    out = ch.patch_alerts(al, ch_, bucket_unit="day")
    snap = out["snapshot"].first()
    assert (snap.title, snap.severity, snap.status, snap.assigned_to_id) == ("New title", "high", "acknowledged", 9)
    assert snap.updated_at == ts("2024-02-02 00:00:00")
    n = out["notifications"].collect()
    assert [(r.user_id, r.type, r.title, r.message) for r in n] == [(9, "alert", "Alert assigned to you", "New title")]
    audit = [(r.action, r.metadata) for r in out["audit"].orderBy("created_at").collect()]
    assert audit == [("alert.updated", '{"status":"open"}'), ("alert.updated", '{"status":"acknowledged"}')]
    assert [r.entity_id for r in out["unknown"].collect()] == [7]


def test_versioned_snapshots(spark, scratch):
    import os

    from nightjar.sinks.snapshots import read_latest, versions, write_version
    path = os.path.join(scratch, "incidents")
    inc = incidents(spark)
    assert write_version(inc, path) == 0
    p = patches(spark, [(1, 1, "2024-02-01 00:00:00", "resolved", False, None)])
    assert write_version(ch.patch_incidents(read_latest(spark, path), p)["snapshot"], path) == 1
    os.makedirs(os.path.join(path, "v=2"))  # a crashed write: no _SUCCESS marker
    assert versions(spark, path) == [0, 1]
    assert read_latest(spark, path).first().status == "resolved"
    assert read_latest(spark, path, 0).first().status == "open"
    assert write_version(inc, path) == 3  # never reuses a folder


def test_create_alerts_with_mappings_audit_and_rejects(spark):
    import json
    c = spark.createDataFrame([(1, "Suspicious login", "high", ["T1078", "T1110", "T1078"]),
                               (2, "", "high", None), (3, "No techniques", "low", None)],
                              "request_id long, title string, severity string, mitre_technique_ids array<string>")
    out = ch.create_alerts(c, AS_OF)
    al = {r.title: r for r in out["alerts"].collect()}
    assert set(al) == {"Suspicious login", "No techniques"} and al["No techniques"].status == "open"
    m = sorted(r.mitre_technique_id for r in out["alert_mitre_mappings"].collect())
    assert m == ["T1078", "T1110"]
    a = {r.metadata for r in out["audit"].collect()}
    assert a == {'{"severity":"high"}', '{"severity":"low"}'}
    assert [r.request_id for r in out["rejected"].collect()] == [2]
    msgs = [json.loads(r.message) for r in out["feed"].collect()]
    assert {tuple(m["data"]["mitre_technique_ids"]) for m in msgs} == {("T1078", "T1110"), ()}


def test_open_incident_audit_and_feed(spark):
    al = mk(spark, "alerts", [])
    req = spark.createDataFrame([(1, "Case", None, None, None, 3, [5], ts("2024-02-01 00:00:00"))],
                                "request_id long, title string, severity string, status string, "
                                "assigned_to_id long, author_id long, alert_ids array<long>, ts timestamp_ntz")
    out = ch.open_incidents(mk(spark, "incidents", []), al, mk(spark, "incident_timeline_events", []), req, AS_OF)
    a = out["audit"].first()
    assert (a.action, a.actor_id, a.metadata) == ("incident.created", 3, '{"severity":"medium"}')
    assert '"type":"incident.created"' in out["feed"].first().message


def test_incident_changes_job(spark, scratch):
    import os

    from nightjar.plans.jobs import incident_changes_job
    from nightjar.sinks.snapshots import read_latest, write_version
    wh = os.path.join(scratch, "wh")
    write_version(incidents(spark), os.path.join(wh, "incidents"))
    p = patches(spark, [(1, 1, "2024-02-01 00:00:00", "closed", True, 4)])
    assert incident_changes_job(spark, wh, p, "b1") == {"incidents_version": 1}
    snap = read_latest(spark, os.path.join(wh, "incidents")).first()
    assert (snap.status, snap.assigned_to_id) == ("closed", 4) and snap.closed_at is not None
    assert spark.read.parquet(os.path.join(wh, "incident_timeline_events")).count() == 1
    assert spark.read.parquet(os.path.join(wh, "notifications")).first().user_id == 4


def test_deletion_audit(spark):
    gone = spark.createDataFrame([(5, 3)], "id long, author_id long")
    r = ch.deletion_audit(gone, "alert", AS_OF).first()
    assert (r.action, r.target_type, r.target_id, r.actor_id, r.created_at) == ("alert.deleted", "alert", "5", 3,
                                                                                AS_OF)


def test_create_and_delete_entities(spark):
    c = spark.createDataFrame([(1, "web-01", "server", None), (2, "", "server", "high"), (3, "db", "mainframe", None)],
                              "request_id long, name string, type string, criticality string")
    out = ch.create_entities(c, "assets", AS_OF)
    rows = out["rows"].collect()
    assert [(r.name, r.criticality, r.tags) for r in rows] == [("web-01", "medium", [])]
    assert out["audit"].first().action == "asset.created"
    assert sorted(r.request_id for r in out["rejected"].collect()) == [2, 3]
    iocs = spark.createDataFrame([("a",), ("b",)], "id string")
    d = ch.delete_rows(iocs, spark.createDataFrame([("a",), ("zz",)], "id string"), "ioc", AS_OF)
    assert [r.id for r in d["table"].collect()] == ["b"] and [r.target_id for r in d["audit"].collect()] == ["a"]
