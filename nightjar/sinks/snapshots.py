"""Versioned table snapshots: the batch form of the reference's transactions.

Applying a batch of changes (M-*) produces a new snapshot of a table.  It is
written to a fresh ``v=<n>`` folder; Spark's commit writes ``_SUCCESS`` last,
so readers take the newest version that has the marker.  A job that dies
mid-write leaves an unmarked folder that nobody reads, and a retried job
writes the next version — no in-place overwrite, no partial table.

Tables that one batch changes become visible together (``write_batch``): their
new versions are written first, and one commit record, written last, names
them all.  Once a warehouse has commit records, ``committed_version`` goes by
them alone, so a version without a record is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, table_path: str, committed_only: bool = True) -> list[int]:
    """Version numbers under ``table_path`` (only committed ones by default)."""
    fs, root = _fs(spark, table_path)
    if not fs.exists(root):
        return []
    out = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v=") and name[2:].isdigit():
            if not committed_only or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                out.append(int(name[2:]))
    return sorted(out)


def write_version(df: DataFrame, table_path: str, version: int | None = None, partition_by: list[str] | None = None,
                  overwrite: bool = False) -> int:
    """Write ``df`` as a new version of the table and return its number
    (next after every existing folder, committed or not, unless given).
    ``overwrite`` replaces what a failed attempt left under that number."""
    spark = df.sparkSession
    if version is None:
        existing = versions(spark, table_path, committed_only=False)
        version = (existing[-1] + 1) if existing else 0
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{table_path.rstrip('/')}/v={version}")
    return version


def read_latest(spark: SparkSession, table_path: str, version: int | None = None) -> DataFrame:
    """The newest committed version (or the given one)."""
    vs = versions(spark, table_path)
    if not vs:
        raise FileNotFoundError(f"no committed version under {table_path}")
    v = vs[-1] if version is None else version
    if v not in vs:
        raise FileNotFoundError(f"version {v} of {table_path} is not committed")
    return spark.read.parquet(f"{table_path.rstrip('/')}/v={v}")


COMMITS = "_commits"


def commits(spark: SparkSession, root: str) -> dict[str, dict[str, tuple[int, int]]]:
    """batch -> table -> (source version, target version) of every committed batch."""
    fs, path = _fs(spark, f"{root.rstrip('/')}/{COMMITS}")
    out: dict[str, dict[str, tuple[int, int]]] = {}
    if not fs.exists(path):
        return out
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        folder = f"{root.rstrip('/')}/{COMMITS}/{name}"
        if name.startswith("batch=") and versions(spark, folder):
            rows = read_latest(spark, folder).collect()  # one row per table
            out[name.removeprefix("batch=")] = {r["table"]: (r["source"], r["target"]) for r in rows}
    return out


def committed_version(spark: SparkSession, root: str, table: str) -> int | None:
    """The version of a table that readers see: the newest one that a commit
    record names, else (a table that no batch has changed) the newest written
    before; None if there is none."""
    named = [t[table][1] for t in commits(spark, root).values() if table in t]
    if named:
        return max(named)
    planned = {r["target"] for plan in _plans(spark, root) for r in plan if r["table"] == table}
    free = [v for v in versions(spark, f"{root.rstrip('/')}/{table}") if v not in planned]
    return free[-1] if free else None


def read_committed(spark: SparkSession, root: str, table: str) -> DataFrame:
    v = committed_version(spark, root, table)
    if v is None:
        raise FileNotFoundError(f"no committed version of {table} under {root}")
    return read_latest(spark, f"{root.rstrip('/')}/{table}", v)


def _plans(spark: SparkSession, root: str) -> list[list]:
    fs, path = _fs(spark, f"{root.rstrip('/')}/_plans")
    if not fs.exists(path):
        return []
    folders = [f"{root.rstrip('/')}/_plans/{st.getPath().getName()}" for st in fs.listStatus(path)]
    return [read_latest(spark, f).collect() for f in folders if versions(spark, f)]


def write_batch(spark: SparkSession, root: str, batch_id: str, tables: Sequence[str],
                change: Callable[[dict[str, DataFrame]], tuple[dict[str, DataFrame], dict[str, DataFrame]]]
                ) -> dict[str, int]:
    """Apply one batch to several tables, visible all at once or not at all.

    First the batch's plan is written: the version of each table that it reads
    and the one that it makes.  ``change`` gets those tables and returns (new
    tables, rows to add per log table); the rows go to
    ``<log>/batch=<batch_id>``, the tables to their planned versions, both
    overwritten by a retry; the commit record is written last.  A retry reads
    the same versions, a batch that is committed changes nothing.  One batch
    at a time changes a warehouse."""
    root = root.rstrip("/")
    done = commits(spark, root).get(batch_id)
    if done is not None:
        return {t: target for t, (_, target) in done.items()}
    plan_path = f"{root}/_plans/batch={batch_id}"
    if not versions(spark, plan_path):
        rows = []
        for t in tables:
            used = versions(spark, f"{root}/{t}", committed_only=False)
            rows.append((t, committed_version(spark, root, t), (used[-1] + 1) if used else 0))
        write_version(spark.createDataFrame(rows, "`table` string, source long, target long"), plan_path, 0,
                      overwrite=True)
    plan = {r["table"]: (r["source"], r["target"]) for r in read_latest(spark, plan_path).collect()}
    old = {t: read_latest(spark, f"{root}/{t}", source) for t, (source, _) in plan.items() if source is not None}
    new, logs = change(old)
    for name, rows in logs.items():
        rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
    for t, df in new.items():
        write_version(df, f"{root}/{t}", plan[t][1], overwrite=True)
    record = [(t, *plan[t]) for t in new]
    write_version(spark.createDataFrame(record, "`table` string, source long, target long"),
                  f"{root}/{COMMITS}/batch={batch_id}", 0, overwrite=True)
    return {t: plan[t][1] for t in new}


# --------------------------------------------------------------------------
# M-2 on large tables: copy-on-write by id bucket
# --------------------------------------------------------------------------
STAGED, COLUMNS = "_staged", "_columns"


def _bucket(id_col: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(buckets)).cast("int")


def _write_buckets(rows: DataFrame, path: str, id_col: str, files: int, dynamic: bool = False) -> None:
    """Rows with a ``bucket`` column, in folders; a bucket is dealt to
    ``files`` tasks, so it may be larger than a task should write."""
    share = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("file")), F.lit(files))
    (rows.repartition("bucket", share).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic" if dynamic else "static").partitionBy("bucket").parquet(path))


def write_bucketed(df: DataFrame, path: str, id_col: str = "id", buckets: int = 256, files: int = 1) -> None:
    """Write a table in folders ``bucket=<n>`` by a hash of its id.  The count
    is for good: choose it so that a bucket is what a small batch may rewrite.
    The columns are kept beside the folders, as an empty table has none."""
    rows = df.withColumn("bucket", _bucket(id_col, buckets))
    _write_buckets(rows, path, id_col, files)
    rows.where("false").write.parquet(f"{path}/{COLUMNS}")


def read_bucketed(spark: SparkSession, path: str) -> DataFrame | None:
    """A table in id buckets, with its ``bucket`` column; None if it is none."""
    fs, folder = _fs(spark, f"{path.rstrip('/')}/{COLUMNS}")
    if not fs.exists(folder):
        return None
    return spark.read.schema(spark.read.parquet(f"{path.rstrip('/')}/{COLUMNS}").schema).parquet(path)


def rewrite_batch(spark: SparkSession, root: str, table: str, batch_id: str, ids: DataFrame,
                  change: Callable[[DataFrame], tuple[DataFrame, dict[str, DataFrame]]],
                  id_col: str = "id", buckets: int = 256, files: int = 1) -> list[int]:
    """Apply one batch to the buckets of ``<root>/<table>`` that hold the
    ``ids`` (a column of the same name): a batch of few entities reads and
    rewrites few folders, whatever the table's size.  ``change`` gets the
    touched buckets' rows and returns (their new rows, with the same columns;
    rows to add per log table).  Returns the touched buckets (at most
    ``buckets`` numbers).

    All that the batch makes is derived from the table as it was and written
    first: the rows of the logs to ``<log>/batch=<batch_id>``, those of the
    buckets to a staging folder, then the list of touched buckets.  Only then
    the staged rows replace the buckets, and a record says so.  A retry that
    finds the list puts the same staged rows in place again; a batch with a
    record changes nothing; a batch that was left between the two is finished
    before the next one starts.  One batch at a time changes a table."""
    root = root.rstrip("/")
    staged = f"{root}/{STAGED}/{table}"
    fs, folder = _fs(spark, staged)
    if fs.exists(folder):
        for st in fs.listStatus(folder):
            _publish(spark, f"{root}/{table}", f"{staged}/{st.getPath().getName()}", id_col, files)
    own = f"{staged}/batch={batch_id}"
    if not versions(spark, f"{own}/touched"):
        touched = sorted(r[0] for r in ids.select(_bucket(id_col, buckets).alias("b")).distinct().collect())
        if touched:
            old = read_bucketed(spark, f"{root}/{table}")
            if old is None:
                raise FileNotFoundError(f"{table} under {root} is not in buckets (write_bucketed)")
            new, logs = change(old.where(F.col("bucket").isin(touched)).drop("bucket"))
            for name, rows in logs.items():
                rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
            _write_buckets(new.select(*[c for c in old.columns if c != "bucket"],
                                      _bucket(id_col, buckets).alias("bucket")), f"{own}/rows", id_col, files)
        write_version(spark.createDataFrame([(b,) for b in touched], "bucket int"), f"{own}/touched", 0,
                      overwrite=True)
        _publish(spark, f"{root}/{table}", own, id_col, files)
    return sorted(r[0] for r in read_latest(spark, f"{own}/touched").collect())


def _publish(spark: SparkSession, path: str, staged: str, id_col: str, files: int) -> None:
    """Put a staged batch in place, unless that is done or it is not whole.
    Buckets that it leaves without rows go."""
    if not versions(spark, f"{staged}/touched") or versions(spark, f"{staged}/done"):
        return
    touched = read_latest(spark, f"{staged}/touched")
    numbers = [r[0] for r in touched.collect()]
    if numbers:
        fs, rows = _fs(spark, f"{staged}/rows")
        names = {st.getPath().getName() for st in fs.listStatus(rows)}
        if any(n.startswith("bucket=") for n in names):
            _write_buckets(spark.read.parquet(f"{staged}/rows"), path, id_col, files, dynamic=True)
        for n in numbers:
            if f"bucket={n}" not in names:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={n}"), True)
    write_version(touched, f"{staged}/done", 0, overwrite=True)


def rewrite_buckets(spark: SparkSession, path: str, ids: DataFrame, change: Callable[[DataFrame], DataFrame],
                    id_col: str = "id", buckets: int = 256, files: int = 1) -> list[int]:
    """``rewrite_batch`` for a change without logs or a batch id of its own:
    a retry is a new batch, so it must be one that gives the same rows again,
    as folded patches do."""
    root, _, table = path.rstrip("/").rpartition("/")
    return rewrite_batch(spark, root, table, uuid.uuid4().hex, ids, lambda old: (change(old), {}), id_col, buckets,
                         files)
