"""Continuous ingestion (ST-1, ST-2, ST-14).

A folder (or Kafka topic) of syslog lines is an unbounded table.  Each
micro-batch runs ``process_ingestion`` — the same function as the batch job —
inside ``foreachBatch``:

* the batch is persisted once and reused by every output (raw events, alerts,
  mappings, freshness, quarantine);
* ids derive from the file path, the line and its number among equal lines
  of the file, so a replayed batch (after a driver or executor loss) recomputes
  the same ids, and every output folder is keyed by the batch id and
  overwritten — replay rewrites, never duplicates;
* lines that do not parse, and events naming an unknown ingestion source,
  go to a quarantine table with a reason instead of failing the batch (ST-2).

The checkpoint lives under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nightjar.functions.scalars import keep_rows
from nightjar.functions.syslog import syslog_payload, with_parsed_syslog
from nightjar.operators.changes import referential_split
from nightjar.operators.detect import DEFAULT_RULES, Rule
from nightjar.session import checkpoint_path
from nightjar.sinks.ingest import process_ingestion


def syslog_lines_stream(spark: SparkSession, directory: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """SRC-3 as a stream: (raw, remote_address, received_at, file_path, block_start).

    ``received_at`` is the file's modification time, so it is the same when a
    micro-batch is replayed (``current_timestamp`` would not be).  The event
    key (file, split, position) is added per micro-batch by ``with_event_key``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.load(directory)
    return df.select(
        F.col("value").alias("raw"),
        F.lit(None).cast("string").alias("remote_address"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("received_at"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def with_event_key(lines: DataFrame) -> DataFrame:
    """(file, line digest, number among the file's equal lines): depends on the
    files alone, not on how a batch is cut into tasks, so a replay on another
    number of cores gets the same keys.  (Equal lines of a file are
    interchangeable, so it does not matter which of them is which number.)"""
    if "event_key" in lines.columns:
        return lines
    nth = F.row_number().over(Window.partitionBy("file_path", "raw").orderBy("block_start"))
    return lines.withColumn("event_key", F.concat_ws(":", "file_path", F.sha2("raw", 256), nth))


def normalize_syslog_batch(lines: DataFrame, source_id: int) -> tuple[DataFrame, DataFrame]:
    """SC-1/SC-2 on a batch of lines → (normalised events, quarantined lines)."""
    return _split_parsed(with_parsed_syslog(lines), source_id)


def _split_parsed(parsed: DataFrame, source_id: int) -> tuple[DataFrame, DataFrame]:
    ok = keep_rows(parsed, F.col("parsed").isNotNull()).select(
        F.lit(source_id).cast("long").alias("ingestion_source_id"), "received_at",
        F.col("remote_address").alias("source_ip"), F.lit("syslog").alias("normalized_type"),
        syslog_payload("parsed", "raw").alias("payload"), "event_key")
    bad = keep_rows(parsed, F.col("parsed").isNull()).select(
        "raw", "received_at", "event_key", F.lit("unparsable syslog line").alias("reason"))
    return ok, bad


def ingest_batch(lines: DataFrame, batch_id: int, sources: DataFrame, out_dir: str, source_id: int,
                 rules: Sequence[Rule] = DEFAULT_RULES) -> dict[str, int]:
    """One micro-batch of syslog lines: normalise, land, detect, write
    (idempotent per batch).  The parsed lines are computed once (kept in
    memory for the batch) and every output is written from them."""
    parsed = with_parsed_syslog(with_event_key(lines)).persist()
    try:
        events, unparsable = _split_parsed(parsed, source_id)
        return write_events_batch(events, unparsable, batch_id, sources, out_dir, rules)
    finally:
        parsed.unpersist()


def write_events_batch(events: DataFrame, quarantined: DataFrame, batch_id: int, sources: DataFrame, out_dir: str,
                       rules: Sequence[Rule] = DEFAULT_RULES) -> dict[str, int]:
    """Land → detect → write every output of one micro-batch under
    ``<table>/batch=<id>`` (overwrite, so a replay rewrites).  ``events`` are
    normalised events with an ``event_key``; ``quarantined`` has (raw,
    received_at, event_key, reason)."""
    # J-11 inside the batch: an event naming an unknown source is quarantined
    events, unknown_src = referential_split(events, sources, "ingestion_source_id")
    quarantined = quarantined.unionByName(unknown_src.select(
        F.col("payload").alias("raw"), "received_at", "event_key", "reason"))
    result = process_ingestion(events, sources, rules, key_col="event_key", persist=True)
    try:
        suffix = f"batch={batch_id}"
        raw = result["raw_events"].withColumn("received_date", F.to_date("received_at"))
        raw.write.mode("overwrite").partitionBy("received_date").parquet(f"{out_dir}/raw_events/{suffix}")
        result["alerts"].write.mode("overwrite").parquet(f"{out_dir}/alerts/{suffix}")
        result["alert_mitre_mappings"].write.mode("overwrite").parquet(f"{out_dir}/alert_mitre_mappings/{suffix}")
        result["feed"].write.mode("overwrite").text(f"{out_dir}/feed/{suffix}")
        (result["raw_events"].groupBy("ingestion_source_id").agg(F.max("received_at").alias("last_ingested_at"))
         .write.mode("overwrite").parquet(f"{out_dir}/source_freshness/{suffix}"))
        quarantined.write.mode("overwrite").parquet(f"{out_dir}/quarantine/{suffix}")
        return {"batch_id": batch_id}
    finally:
        result["detected"].unpersist()


# --------------------------------------------------------------------------
# uploads (SRC-2 / SRC-8 / SRC-9) as a stream
# --------------------------------------------------------------------------
def upload_files_stream(spark: SparkSession, directory: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A folder where uploaded files land, one row per file (the whole text),
    with the file time as receipt time."""
    reader = spark.readStream.format("text").option("wholetext", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(directory).select(
        F.col("_metadata.file_path").alias("file"), F.col("value"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("received_at"))


def ingest_uploads_batch(files: DataFrame, batch_id: int, sources: DataFrame, out_dir: str, source_id: int,
                         max_rows: int | None = None, rules: Sequence[Rule] = DEFAULT_RULES) -> dict[str, int]:
    """One micro-batch of upload files.  A ``.json`` file must be a JSON array
    (else the file is quarantined: "JSON file must contain an array of records"
    or "Failed to parse JSON file"); any other file is CSV, read by its own
    header (``sources.files.read_csv_files``).  Where ``max_rows`` is given, a
    file with more records is quarantined whole, with its text; every record
    becomes an event (payload = record JSON text, source ip per SRC-8,
    key = file + position)."""
    from nightjar.sources.files import read_csv_files
    from nightjar.sources.upload import source_ip_from_json
    is_json = F.lower("file").endswith(".json")
    parsed = files.select("file", "value", "received_at", is_json.alias("is_json"),
                          F.when(is_json, F.from_json("value", "array<string>")).alias("records")).persist()
    try:
        bad = parsed.where(F.col("is_json") & F.col("records").isNull()).select(
            F.col("value").alias("raw"), "received_at", F.col("file").alias("event_key"),
            F.when(F.try_parse_json("value").isNotNull(), F.lit("JSON file must contain an array of records"))
            .otherwise(F.lit("Failed to parse JSON file")).alias("reason"))
        arrays = parsed.where(F.col("records").isNotNull()).select(
            "file", "received_at", F.size("records").alias("n_records"),
            F.posexplode("records").alias("ordinal", "record"))
        rows = arrays.unionByName(read_csv_files(parsed.where("not is_json").select("file", "value", "received_at"))
                                  .select(*arrays.columns))
        if max_rows is not None:
            n = F.col("n_records")
            reason = F.concat(F.lit("File contains "), n, F.lit(f" rows; max is {max_rows}"))
            too_big = (rows.where(n > max_rows).groupBy("file").agg(F.first(reason).alias("reason"))
                       .join(parsed.select("file", "value", "received_at"), "file"))
            bad = bad.unionByName(too_big.select(F.col("value").alias("raw"), "received_at",
                                                 F.col("file").alias("event_key"), "reason"))
            rows = rows.where(n <= max_rows)
        events = rows.select(
            F.lit(source_id).cast("long").alias("ingestion_source_id"), "received_at",
            source_ip_from_json("record").alias("source_ip"), F.lit("file_upload").alias("normalized_type"),
            F.col("record").alias("payload"), F.concat(F.col("file"), F.lit(":"), F.col("ordinal")).alias("event_key"))
        return write_events_batch(events, bad, batch_id, sources, out_dir, rules)
    finally:
        parsed.unpersist()


def _own_checkpoint(spark: SparkSession, kind: str, source_dir: str, out_dir: str) -> str:
    """A checkpoint folder per stream: two streams of one kind never share one."""
    return checkpoint_path(spark, f"{kind}-{hashlib.sha256(f'{source_dir}|{out_dir}'.encode()).hexdigest()[:16]}")


def ingest_upload_stream(spark: SparkSession, source_dir: str, out_dir: str, sources: DataFrame, source_id: int,
                         checkpoint: str | None = None, available_now: bool = True, max_rows: int | None = None,
                         max_files_per_trigger: int | None = None, rules: Sequence[Rule] = DEFAULT_RULES):
    """ST-1 for uploads: start the stream over the upload folder."""
    files = upload_files_stream(spark, source_dir, max_files_per_trigger)
    ckpt = checkpoint or _own_checkpoint(spark, "upload_stream", source_dir, out_dir)
    writer = (files.writeStream.option("checkpointLocation", ckpt)
              .foreachBatch(lambda df, bid: ingest_uploads_batch(df, bid, sources, out_dir, source_id, max_rows,
                                                                 rules)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def ingest_stream(spark: SparkSession, source_dir: str, out_dir: str, sources: DataFrame, source_id: int = 2,
                  checkpoint: str | None = None, available_now: bool = True,
                  max_files_per_trigger: int | None = None, lines: DataFrame | None = None,
                  dedupe_keys: Sequence[str] | None = None, dedupe_watermark: str = "1 hour",
                  rules: Sequence[Rule] = DEFAULT_RULES):
    """ST-1: start the ingest stream; returns the ``StreamingQuery``.

    The file source is exactly-once by itself (its checkpoint records the
    files done).  For an at-least-once source passed as ``lines`` (e.g. Kafka
    with an ``event_key`` built from topic/partition/offset), ``dedupe_keys``
    (ST-14) drops redeliveries within ``dedupe_watermark`` of event time."""
    if lines is None:
        lines = syslog_lines_stream(spark, source_dir, max_files_per_trigger)
    if dedupe_keys:
        lines = (lines.withColumn("_evt", F.col("received_at").cast("timestamp"))
                 .withWatermark("_evt", dedupe_watermark)
                 .dropDuplicatesWithinWatermark(list(dedupe_keys)).drop("_evt"))
    ckpt = checkpoint or _own_checkpoint(spark, "ingest_stream", source_dir, out_dir)
    writer = (lines.writeStream.option("checkpointLocation", ckpt)
              .foreachBatch(lambda df, bid: ingest_batch(df, bid, sources, out_dir, source_id, rules)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_ingest_output(spark: SparkSession, out_dir: str, table: str) -> DataFrame:
    """The union of all batch folders of one output table."""
    return spark.read.parquet(f"{out_dir}/{table}")
