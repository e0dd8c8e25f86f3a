"""Ingest-side sinks and the end-to-end ingestion step (SNK-3..SNK-7, DET-5).

``process_ingestion`` is one pure function from a batch of normalised events
to the tables it changes; the batch job and the streaming ``foreachBatch``
call the same function, so stream = batch by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.functions.scalars import iso_utc, stable_id
from nightjar.operators.detect import DEFAULT_RULES, Rule, alerts_from_detections, detect


def raw_event_ids(events: DataFrame, key_col: str | None = None) -> Column:
    """Deterministic raw-event id: the source plus the event key when the
    source has one (Kafka offset, file + line), else source, payload, receipt
    time and, for events that agree in all of these, their number.  A replayed
    batch gets the same ids (ST-14)."""
    if key_col:
        return stable_id(F.lit("raw"), F.col("ingestion_source_id"), F.col(key_col))
    same = ["ingestion_source_id", "payload", "received_at"]
    rest = [F.col(c) for c in events.columns if c not in same]
    nth = F.row_number().over(Window.partitionBy(*same).orderBy(*(rest or [F.lit(0)])))
    return stable_id(F.lit("raw"), *[F.col(c) for c in same], F.when(nth > 1, nth.cast("string")).otherwise(F.lit("")))


def land(events: DataFrame, key_col: str | None = None) -> DataFrame:
    """SNK-3 (the rows): every normalised event becomes a raw event row,
    whether or not a rule fires."""
    cols = ["ingestion_source_id", "received_at", "source_ip", "normalized_type", "payload"]
    return events.select(raw_event_ids(events, key_col).alias("id"), *cols)


def refresh_source_freshness(sources: DataFrame, batch: DataFrame) -> DataFrame:
    """SNK-6: ``last_ingested_at`` = the newest receipt time per source (never
    moves back).  The batch is folded per source before the join."""
    newest = batch.groupBy(F.col("ingestion_source_id").alias("id")).agg(F.max("received_at").alias("_newest"))
    j = sources.join(newest, "id", "left")
    last = F.greatest(F.col("last_ingested_at"), F.col("_newest"))  # greatest skips nulls
    return j.select(*[last.alias(c) if c == "last_ingested_at" else F.col(c) for c in sources.columns])


def realtime_feed(rows: DataFrame, event_type: str) -> DataFrame:
    """SNK-5: one JSON message ``{"type": …, "data": {…row}}`` per new row;
    timestamps rendered as ISO-8601 UTC with ms, nulls kept."""
    fields = []
    for f in rows.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = iso_utc(c)
        fields.append(c.alias(f.name))
    msg = F.struct(F.lit(event_type).alias("type"), F.struct(*fields).alias("data"))
    return rows.select(F.to_json(msg, {"ignoreNullFields": "false"}).alias("message"))


def process_ingestion(events: DataFrame, sources: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES,
                      key_col: str | None = None, persist: bool = False) -> dict[str, DataFrame]:
    """DET-5: land → touch sources → detect → alerts + mappings → feed.

    ``events`` holds normalised events (ingestion_source_id, received_at,
    source_ip, normalized_type, payload[, key_col]).  ``persist=True`` (used
    by the micro-batch writer) keeps the landed-and-detected rows in memory
    so the outputs written one after the other do not recompute them; the
    caller unpersists ``result["detected"]``."""
    detected = detect(land(events, key_col), rules)
    if persist:
        detected = detected.persist()
    raw = detected.drop("detection")
    alerts, mappings, serialized = alerts_from_detections(detected)
    return {
        "detected": detected,
        "raw_events": raw,
        "sources": refresh_source_freshness(sources, raw),
        "alerts": alerts,
        "alert_mitre_mappings": mappings,
        "alerts_serialized": serialized,
        "feed": realtime_feed(alerts.drop("raw_event_id"), "alert.created"),
    }


def audit_sink(audit_rows: DataFrame, path: str, batch_id: str | None = None) -> None:
    """SNK-7: append-only audit log partitioned by day (never updated).

    With ``batch_id`` the rows go to that batch's own folder, which a retried
    job writes again instead of appending twice; ``sources.tables.scan`` and
    a plain read of ``path`` see the rows of all batches."""
    rows = audit_rows if "created_date" in audit_rows.columns else audit_rows.withColumn(
        "created_date", F.to_date("created_at"))
    if batch_id is None:
        rows.write.mode("append").partitionBy("created_date").parquet(path)
    else:
        rows.write.mode("overwrite").partitionBy("created_date").parquet(f"{path.rstrip('/')}/batch={batch_id}")
