"""Upload handling: source-ip resolution (SRC-8), the row guard (SRC-9) and
turning uploaded records into normalised events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar import schemas
from nightjar.functions.scalars import ColumnOrName, _col

# Candidate keys for the source address, in priority order (fixed values).
SOURCE_IP_KEYS = ["ip", "sourceIp", "source_ip", "src_ip"]


def source_ip_from_json(record: ColumnOrName) -> Column:
    """SRC-8 over JSON text: ``ip ?? sourceIp ?? source_ip ?? src_ip``, falling
    through only on missing / JSON null, and null unless the winner is a string
    (an empty string wins; a number wins and yields null)."""
    v = F.try_parse_json(_col(record))
    cands = [F.try_variant_get(v, f"$.{k}", "variant") for k in SOURCE_IP_KEYS]
    winner = F.coalesce(*[F.when(~F.is_variant_null(c), c) for c in cands])
    return F.when(F.schema_of_variant(winner) == F.lit("STRING"), F.try_variant_get(winner, "$", "string"))


def source_ip_from_columns(df: DataFrame) -> Column:
    """SRC-8 over CSV rows (all strings): the first candidate column present.
    CSV cells are never null after ``read_csv_events``, so the first existing
    column wins, matching ``??`` on strings."""
    present = [k for k in SOURCE_IP_KEYS if k in df.columns]
    return F.coalesce(*[F.col(f"`{k}`") for k in present]) if present else F.lit(None).cast("string")


def guard_max_rows(records: DataFrame, file_col: str = "file",
                   max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC-9: split records into (accepted, rejected_files).  A file with more
    than ``max_rows`` records is rejected whole.  The guard is off unless a
    bound is given (the upload form's is ``schemas.MAX_UPLOAD_ROWS``)."""
    if max_rows is None:
        return records, records.sparkSession.createDataFrame([], f"{file_col} string, n_rows long, reason string")
    per_file = records.groupBy(file_col).agg(F.count(F.lit(1)).alias("n_rows"))
    too_big = per_file.where(F.col("n_rows") > max_rows).withColumn(
        "reason", F.concat(F.lit("File contains "), F.col("n_rows"), F.lit(f" rows; max is {max_rows}")))
    accepted = records.join(too_big.select(file_col), file_col, "left_anti")
    return accepted, too_big


def normalize_records(records: DataFrame, source_id: ColumnOrName, received_at: ColumnOrName,
                      record_col: str = "record") -> DataFrame:
    """Uploaded JSON records → normalised events (source, received_at,
    source_ip, normalized_type 'file_upload', payload = the record text)."""
    return records.select(
        _col(source_id).alias("ingestion_source_id"),
        _col(received_at).alias("received_at"),
        source_ip_from_json(record_col).alias("source_ip"),
        F.lit("file_upload").alias("normalized_type"),
        F.col(record_col).alias("payload"),
        *[c for c in records.columns if c in ("file", "ordinal")],
    )


def csv_rows_to_json(df: DataFrame) -> Column:
    """A CSV row (all string columns) as JSON text with header order kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns]))


def read_upload(spark, path: str, source_id: int, received_at, max_rows: int | None = None
                ) -> tuple[DataFrame, DataFrame]:
    """Upload → normalised events (the ``/ingest/upload`` flow).

    A path ending in ``.json`` (one file or a folder of them) must hold a JSON
    array per file; otherwise it holds CSV uploads, each with its own header.  Each
    record becomes an event: source ``source_id``, type ``file_upload``,
    payload = the record as JSON text, source ip per SRC-8.  Returns
    (events, rejected files with a reason): not an array, unparsable, or
    more than ``max_rows`` records where a bound is given (SRC-9)."""
    from nightjar.functions.scalars import ts_literal
    from nightjar.sources.files import read_csv_files, read_json_events

    ts = ts_literal(received_at) if not hasattr(received_at, "_jc") else received_at
    if path.lower().rstrip("/").endswith(".json") or path.lower().rstrip("/").endswith("json"):
        recs = read_json_events(spark, path)
        raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
        bad = (recs.where("rejected").select("file").distinct().join(raw, "file", "left")
               .select("file", F.when(F.try_parse_json("value").isNotNull(),
                                      F.lit("JSON file must contain an array of records"))
                       .otherwise(F.lit("Failed to parse JSON file")).alias("reason")))
        ok = recs.where(~F.col("rejected")).select("file", "ordinal", "record")
        accepted, too_big = guard_max_rows(ok, "file", max_rows)
        events = accepted.select(
            F.lit(source_id).cast("long").alias("ingestion_source_id"), ts.alias("received_at"),
            source_ip_from_json("record").alias("source_ip"), F.lit("file_upload").alias("normalized_type"),
            F.col("record").alias("payload"), "file", "ordinal")
    else:
        files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
        accepted, too_big = guard_max_rows(read_csv_files(files), "file", max_rows)
        bad = spark.createDataFrame([], "file string, reason string")
        events = accepted.select(
            F.lit(source_id).cast("long").alias("ingestion_source_id"), ts.alias("received_at"),
            source_ip_from_json("record").alias("source_ip"), F.lit("file_upload").alias("normalized_type"),
            F.col("record").alias("payload"), "file", "ordinal")
    rejected = bad.unionByName(too_big.select("file", "reason"))
    return events, rejected
