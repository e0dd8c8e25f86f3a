"""SRC-4 / SRC-5 / SRC-6: table scans, the technique dimension, source registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar import schemas


def conform(df: DataFrame, entity: str) -> DataFrame:
    """Rows of any writer with the entity's declared columns and types: ids of
    older tables (numbers) become text, columns that a table lacks are null.
    A projection only, so pruning and filters still reach the scan."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schemas.ENTITY_SCHEMAS[entity].fields])


def scan(spark: SparkSession, path: str, entity: str, order_by: list[str] | None = None) -> DataFrame:
    """SRC-4: read an entity table with its declared columns.  The table is a
    plain Parquet folder, one with ``batch=`` folders (all of them are read),
    one in id buckets, or one with ``v=`` versions (the committed one is, by
    the warehouse's commit records where it has any)."""
    from nightjar.sinks.snapshots import read_bucketed, read_committed, versions
    root, _, name = path.rstrip("/").rpartition("/")
    if versions(spark, path):
        df = read_committed(spark, root, name)
    else:
        df = read_bucketed(spark, path)
        df = spark.read.parquet(path) if df is None else df
    out = conform(df, entity)
    return out.orderBy(*order_by) if order_by else out


def mitre_dimension(spark: SparkSession) -> DataFrame:
    """SRC-5: the 33-row technique dimension (id, name, tactic, url).

    A fixed-size reference table, so callers may broadcast it."""
    rows = [(i, n, t) for i, n, t in schemas.MITRE_TECHNIQUES]
    df = spark.createDataFrame(rows, "id string, name string, tactic string")
    return df.withColumn("url", F.concat(F.lit(schemas.MITRE_URL_PREFIX), F.col("id"), F.lit("/")))


def upsert_techniques(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """SRC-5 seeding: upsert by id, updating name and tactic, keeping url."""
    u = updates.select("id", F.col("name").alias("_n"), F.col("tactic").alias("_t"))
    kept = existing.join(u, "id", "left").select(
        "id", F.coalesce("_n", "name").alias("name"), F.coalesce("_t", "tactic").alias("tactic"), "url")
    new = updates.join(existing.select("id"), "id", "left_anti").select(
        "id", "name", "tactic", F.concat(F.lit(schemas.MITRE_URL_PREFIX), F.col("id"), F.lit("/")).alias("url"))
    return kept.unionByName(new)


def ensure_sources(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """SRC-6: get-or-create one canonical source per type.

    ``wanted`` holds candidate rows with the registry's columns; a type that
    already has a source is left alone (never duplicated), and several
    candidates of one new type collapse to the one with the smallest id.
    Returns the new registry (existing rows first)."""
    cols = existing.columns
    rest = [c for c in cols if c != "type"]
    new = (wanted.select(*cols).join(existing.select("type").distinct(), "type", "left_anti")
           .groupBy("type").agg(F.min_by(F.struct(*rest), F.col("id")).alias("_w"))
           .select("type", "_w.*").select(*cols))
    return existing.unionByName(new)
