"""F-*, P-*, SO-*, J-2, J-10, A-12, A-13 (reference list/hunt cases)."""

import pytest

from helpers import mk
from nightjar.operators import analytics as an
from nightjar.operators import listing as ls
from nightjar.sources.tables import mitre_dimension


def assets(spark):
    rows = [dict(id=i, name=f"h{i}", type="server", criticality=c, created_at=f"2024-01-0{i} 00:00:00")
            for i, c in [(1, "critical"), (2, "low"), (3, "critical"), (4, "info"), (5, "high")]]
    return mk(spark, "assets", rows)


def test_criticality_filter_and_page_size_one(spark):
    env = ls.paged(ls.equality_filters(assets(spark), {"criticality": "critical", "type": None}), 1, 1)
    items, total = env["items"].collect(), env["total"].first().total
    assert len(items) == 1 and total == 2 and items[0].id == 3  # newest first


def test_enum_sort_uses_declaration_rank(spark):
    desc = [r.criticality for r in ls.page(assets(spark), 1, 10, "criticality", "desc", "assets").collect()]
    assert desc == ["info", "low", "high", "critical", "critical"]
    asc = [r.id for r in ls.page(assets(spark), 1, 10, "criticality", "asc", "assets").collect()]
    assert asc == [1, 3, 5, 2, 4]


def test_whitelist_and_bounds(spark):
    with pytest.raises(ValueError):
        ls.page(assets(spark), 1, 10, "hostname", "desc", "assets")
    with pytest.raises(ValueError):
        ls.page(assets(spark), 1, 101)
    with pytest.raises(ValueError):
        ls.page(assets(spark), 0, 10)


def test_pages_do_not_overlap(spark):
    df = spark.range(57).selectExpr("id", "timestamp_ntz'2024-01-01 00:00:00' AS created_at")
    seen = []
    for p in range(1, 4):
        seen += [r.id for r in ls.page(df, p, 25).collect()]
    assert sorted(seen) == list(range(57)) and len(seen) == 57


def test_keyset_page(spark):
    df = spark.range(10).selectExpr("id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) "
                                    "AS received_at")
    first = ls.keyset_page(df, 4, "received_at").collect()
    nxt = ls.keyset_page(df, 4, "received_at", (first[-1].received_at, first[-1].id)).collect()
    assert [r.id for r in first] == [9, 8, 7, 6] and [r.id for r in nxt] == [5, 4, 3, 2]


def test_page_bounds(spark):
    tot = spark.createDataFrame([(0,), (51,)], "total long")
    out = [r.asDict() for r in ls.page_bounds(tot, 3, 25).collect()]
    assert out[0] == {"total": 0, "total_pages": 1, "start": 0, "end": 0}
    assert out[1] == {"total": 51, "total_pages": 3, "start": 51, "end": 51}


def test_hunting_filters(spark):
    raw = spark.createDataFrame(
        [(1, 1, "2024-01-02 00:00:00", "10.0.0.5", "syslog"), (2, 1, "2024-01-03 00:00:00", "192.168.1.9", "syslog"),
         (3, 2, "2024-01-04 00:00:00", "10.0.0.7", "file_upload")],
        "id long, ingestion_source_id long, received_at string, source_ip string, normalized_type string"
    ).selectExpr("*", "cast(received_at as timestamp_ntz) as r").drop("received_at").withColumnRenamed(
        "r", "received_at")
    env = ls.hunt_raw_events(raw, source_ip="10.0.")
    assert [r.id for r in env["items"].collect()] == [3, 1] and env["total"].first().total == 2
    env = ls.hunt_raw_events(raw, ingestion_source_id=1, since="2024-01-03 00:00:00")
    assert [r.id for r in env["items"].collect()] == [2]
    assert ls.hunt_raw_events(raw, source_ip="")["total"].first().total == 3  # empty = absent


def test_techniques_by_tactic(spark):
    dim = mitre_dimension(spark)
    assert [r.id for r in an.techniques_by_tactic(dim, "Impact").collect()] == ["T1486", "T1490"]
    assert an.techniques_by_tactic(dim, "Nope").count() == 0
    assert dim.count() == 33


def test_notifications_own_rows_and_unread(spark):
    n = mk(spark, "notifications", [
        dict(id=1, user_id=7, type="system", title="a", message="m", created_at="2024-01-01 00:00:00"),
        dict(id=2, user_id=7, type="system", title="b", message="m", created_at="2024-01-02 00:00:00",
             read_at="2024-01-03 00:00:00"),
        dict(id=3, user_id=8, type="system", title="c", message="m", created_at="2024-01-02 00:00:00")])
    env = ls.list_notifications(n, 7, unread_only=True)
    assert [r.id for r in env["items"].collect()] == [1] and env["unread"].first().unread == 1
    assert {r.user_id: r.unread for r in ls.unread_count(n).collect()} == {7: 1, 8: 1}


def test_public_users_projection(spark):
    u = mk(spark, "users", [dict(id=1, email="a@x", name="A", role="admin", is_active=True,
                                 created_at="2024-01-01 00:00:00")]).withColumn("password_hash", __import__(
                                     "pyspark.sql.functions", fromlist=["lit"]).lit("secret"))
    assert ls.public_users(u).columns == ["id", "email", "name", "role", "is_active", "created_at"]


def test_audit_view(spark):
    a = mk(spark, "audit_logs", [
        dict(id=1, actor_id=1, action="alert.created", target_type="alert", target_id="0123456789abcdef",
             ip_address="1.2.3.4", created_at="2024-01-01 00:00:00"),
        dict(id=2, action="system.tick", created_at="2024-01-01 00:00:00")])
    u = mk(spark, "users", [dict(id=1, email="a@x", name="A", role="admin", is_active=True,
                                 created_at="2024-01-01 00:00:00")])
    out = {r.id: (r.actor, r.target, r.ip_address) for r in ls.audit_view(a, u).collect()}
    assert out == {1: ("a@x", "alert:01234567", "1.2.3.4"), 2: ("system", "—", "—")}


def test_incident_detail_and_overview(spark):
    inc = mk(spark, "incidents", [dict(id=1, title="i", severity="high", status="open",
                                       created_at="2024-01-01 00:00:00")])
    al = mk(spark, "alerts", [dict(id=5, title="a", severity="critical", status="open", incident_id=1,
                                   created_at="2024-01-02 00:00:00"),
                              dict(id=6, title="b", severity="low", status="open", created_at="2024-01-02 00:00:00")])
    tl = mk(spark, "incident_timeline_events", [
        dict(id="t1", incident_id=1, event_type="note", message="Incident opened", created_at="2024-01-01 00:00:00"),
        dict(id="t2", incident_id=1, event_type="status_change", message="later", created_at="2024-01-03 00:00:00")])
    d = ls.incident_detail(inc, al, tl, 1)
    assert [r.id for r in d["alerts"].collect()] == [5]
    assert [r.message for r in d["timeline"].collect()] == ["Incident opened", "later"]
    o = ls.incident_overview(inc, al, tl).first()
    assert (o.alert_count, o.critical_alert_count, o.timeline_count, o.first_entry, o.last_entry) == (
        1, 1, 2, "Incident opened", "later")
    assert ls.incident_detail(inc, al, tl, 99)["incident"].count() == 0


def test_skew_safe_lookup_equals_plain_join(spark):
    from pyspark.sql import functions as F
    fact = spark.range(3000).select(F.col("id").alias("row"),
                                    F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50)
                                    .cast("long").alias("asset_id"),
                                    F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.lit(1)).alias("flag"))
    fact = fact.withColumn("asset_id", F.when(F.col("flag").isNull(), F.lit(None).cast("long"))
                           .otherwise(F.col("asset_id"))).drop("flag")
    dim = spark.range(40).select(F.col("id").alias("asset_id"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    plain = sorted(tuple(r) for r in fact.join(dim, "asset_id", "left").select("row", "asset_id", "name").collect())
    salted = sorted(tuple(r) for r in ls.skew_safe_lookup(fact, dim, "asset_id", 0.2, 8)
                    .select("row", "asset_id", "name").collect())
    assert plain == salted and len(salted) == 3000


def test_asset_name_lookup_salted(spark):
    v = mk(spark, "vulnerabilities", [dict(id=f"v{i}", title="t", severity="low", status="open",
                                           asset_id=1 if i % 2 else (None if i % 3 else 2),
                                           discovered_at="2024-01-01 00:00:00", created_at="2024-01-01 00:00:00")
                                      for i in range(30)])
    a = assets(spark)
    plain = sorted((r.id, r.asset_name) for r in ls.with_asset_name(v, a).collect())
    salted = sorted((r.id, r.asset_name) for r in ls.with_asset_name(v, a, hot_share=0.3).collect())
    assert plain == salted and ("v1", "h1") in plain and ("v3", "h1") in plain


def test_route_list_functions(spark):
    inc = mk(spark, "incidents", [dict(id=i, title=f"i{i}", severity=s, status=st, created_at=f"2024-01-0{i} 00:00:00")
                                  for i, s, st in [(1, "high", "open"), (2, "low", "open"), (3, "high", "closed")]])
    env = ls.list_incidents(inc, status="open", severity="high")
    assert [r.id for r in env["items"].collect()] == [1] and env["total"].first().total == 1
    assert [r.id for r in ls.list_assets(assets(spark), criticality="critical", sort_by="name",
                                         order="asc")["items"].collect()] == [1, 3]
    src = spark.createDataFrame([(2, "b"), (1, "a")], "id long, name string").selectExpr(
        "id", "name", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) AS created_at")
    assert [r.id for r in ls.list_sources(src).collect()] == [1, 2]


def test_more_route_lists(spark):
    iocs = mk(spark, "iocs", [dict(id=f"ip:{i}", type="ip" if i % 2 else "domain", value=str(i),
                                   severity="high" if i < 3 else "low", first_seen_at="2024-01-01 00:00:00",
                                   last_seen_at=f"2024-01-0{i} 00:00:00", created_at=f"2024-01-0{i} 00:00:00")
                              for i in range(1, 6)])
    env = ls.list_iocs(iocs, type="ip", sort_by="last_seen_at", order="asc")
    assert [r.value for r in env["items"].collect()] == ["1", "3", "5"] and env["total"].first().total == 3
    v = mk(spark, "vulnerabilities", [dict(id=f"v{i}", title="t", severity="critical", status="open" if i % 2 else
                                           "remediated", asset_id=1, discovered_at=f"2024-01-0{i} 00:00:00",
                                           created_at="2024-01-01 00:00:00") for i in range(1, 5)])
    assert ls.list_vulnerabilities(v, status="open")["total"].first().total == 2
    a = mk(spark, "audit_logs", [dict(id=i, action="alert.created" if i < 3 else "ioc.deleted", actor_id=1,
                                      created_at=f"2024-01-0{i} 00:00:00") for i in range(1, 5)])
    assert [r.id for r in ls.list_audit_logs(a, action="alert.created", order="asc")["items"].collect()] == [1, 2]


def test_cluster_conf_sizes_partitions():
    from nightjar.session import cluster_conf
    c = cluster_conf(shuffle_bytes_estimate=100 * 2**40, executor_cores_total=8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 100 * 2**40 // (128 * 2**20)
    assert c["spark.sql.adaptive.enabled"] == "true" and c["spark.sql.files.maxPartitionBytes"] == "256m"
    small = cluster_conf(shuffle_bytes_estimate=1, executor_cores_total=100)
    assert small["spark.sql.shuffle.partitions"] == "300"
