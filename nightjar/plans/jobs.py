"""Batch job entry points for a cluster run.

Domain tables live as Parquet folders under one warehouse path
(``<warehouse>/<entity>``, read with their declared schemas).  Each job is a
plain function a scheduler calls with a session, paths and ``as_of``; every
output is a distributed write, nothing passes through the driver.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.operators import analytics as an
from nightjar.session import apply_core_conf
from nightjar.sources.tables import mitre_dimension, scan


def _t(spark: SparkSession, warehouse: str, entity: str) -> DataFrame:
    return scan(spark, f"{warehouse.rstrip('/')}/{entity}", entity)


def analytics_job(spark: SparkSession, warehouse: str, out: str, as_of: dt.datetime | str, days: int = 30,
                  timeline_limit: int = 200) -> dict[str, str]:
    """Refresh the analytics outputs (A-1..A-9, J-7, SET-1) under ``out``."""
    apply_core_conf(spark)
    alerts = _t(spark, warehouse, "alerts")
    mappings = _t(spark, warehouse, "alert_mitre_mappings")
    incidents = _t(spark, warehouse, "incidents")
    vulns = _t(spark, warehouse, "vulnerabilities")
    assets = _t(spark, warehouse, "assets")
    raw = _t(spark, warehouse, "raw_events")
    sources = _t(spark, warehouse, "ingestion_sources")
    techniques = mitre_dimension(spark)
    results = {
        "alerts_trend": an.alerts_trend(alerts, days, as_of),
        "alerts_heatmap": an.heatmap_levels(an.heatmap_grid(an.alerts_heatmap(alerts, days, as_of))),
        "mitre_frequency": an.mitre_frequency(mappings, techniques),
        "technique_matrix": an.technique_matrix(techniques, mappings),
        "detection_by_source": an.detection_by_source(sources, raw, alerts),
        "detection_by_rule": an.detection_by_rule(alerts, mappings),
        "asset_risk": an.asset_risk(assets, vulns, alerts),
        "dashboard_summary": an.dashboard_summary(alerts, incidents, vulns, assets),
        "timeline": an.timeline(alerts, incidents, mappings, days, timeline_limit, as_of),
    }
    paths = {}
    for name, df in results.items():
        paths[name] = f"{out.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def incident_changes_job(spark: SparkSession, warehouse: str, changes: DataFrame, batch_id: str) -> dict[str, object]:
    """Apply one batch of incident patches (M-5): timeline, notification, audit
    and rejected rows go to ``<table>/batch=<batch_id>``, and the new version
    of the incidents is committed last (``snapshots.write_batch``)."""
    from nightjar.operators.changes import patch_incidents
    from nightjar.sinks.snapshots import write_batch
    apply_core_conf(spark)

    def change(old):
        out = patch_incidents(old["incidents"], changes.persist())
        logs = {"incident_timeline_events": "timeline", "notifications": "notifications", "audit_logs": "audit",
                "rejected_incident_patches": "unknown"}
        return {"incidents": out["snapshot"]}, {t: out[k] for t, k in logs.items() if out.get(k) is not None}
    try:
        return {"incidents_version": write_batch(spark, warehouse, batch_id, ["incidents"], change)["incidents"]}
    finally:
        changes.unpersist()


def patch_job(spark: SparkSession, warehouse: str, entity: str, changes: DataFrame, batch_id: str,
              buckets: int = 256, files: int = 1) -> list[int]:
    """One batch of field patches (M-2, M-5..M-7, M-10, M-11) on a table in id
    buckets (``snapshots.write_bucketed``): only the buckets of the patched
    ids are read and rewritten.  Audit, notification, timeline and rejected
    rows go to ``<log>/batch=<batch_id>``.  Returns the touched buckets."""
    from nightjar.operators import changes as ch
    from nightjar.sinks.snapshots import rewrite_batch
    apply_core_conf(spark)
    patch = {"incidents": ch.patch_incidents, "alerts": ch.patch_alerts, "assets": ch.patch_assets,
             "vulnerabilities": ch.patch_vulnerabilities, "iocs": ch.patch_iocs}[entity]
    logs = {"incident_timeline_events": "timeline", "notifications": "notifications", "audit_logs": "audit",
            f"rejected_{ch.SINGULAR[entity]}_patches": "unknown"}

    def change(old):
        out = patch(old, changes)
        return out["snapshot"], {t: out[k] for t, k in logs.items() if out.get(k) is not None}
    changes.persist()
    try:
        return rewrite_batch(spark, warehouse, entity, batch_id, changes.select(F.col("entity_id").alias("id")), change,
                             buckets=buckets, files=files)
    finally:
        changes.unpersist()


def open_incidents_job(spark: SparkSession, warehouse: str, requests: DataFrame, batch_id: str,
                       as_of: dt.datetime | str) -> dict[str, int]:
    """M-4 as one transaction: the new incidents, their seed notes and the
    linked alerts become visible together; audit rows and feed messages go to
    ``<log>/batch=<batch_id>``.  Returns the committed versions."""
    from nightjar.operators.changes import open_incidents
    from nightjar.sinks.snapshots import write_batch
    apply_core_conf(spark)

    def change(old):
        out = open_incidents(old["incidents"], old["alerts"], old["incident_timeline_events"], requests, as_of)
        return ({"incidents": out["incidents"], "alerts": out["alerts"], "incident_timeline_events": out["timeline"]},
                {"audit_logs": out["audit"], "feed": out["feed"]})
    return write_batch(spark, warehouse, batch_id, ["incidents", "alerts", "incident_timeline_events"], change)


def delete_job(spark: SparkSession, warehouse: str, entity: str, deleted: DataFrame, batch_id: str,
               as_of: dt.datetime | str) -> dict[str, int]:
    """M-8 as one transaction: the rows of ``entity`` with the ids in
    ``deleted`` go, and every table that refers to them changes with them."""
    from nightjar import schemas
    from nightjar.operators.changes import SINGULAR, delete_entities, deletion_audit
    from nightjar.sinks.snapshots import versions, write_batch
    apply_core_conf(spark)
    tables, queue = [entity], [entity]
    while queue:
        parent = queue.pop()
        for child, _, target, action in schemas.FOREIGN_KEYS:
            if target == parent and child not in tables and versions(spark, f"{warehouse.rstrip('/')}/{child}"):
                tables.append(child)
                queue += [child] if action == "cascade" else []

    def change(old):
        known = deleted.join(old[entity].select("id"), "id", "left_semi")
        return (delete_entities(old, entity, deleted),
                {"deletion_audit": deletion_audit(known, SINGULAR[entity], as_of)})
    return write_batch(spark, warehouse, batch_id, tables, change)
