"""Spark session helpers.

Library code never creates a session of its own: every operator takes the
DataFrames it works on.  ``local_session`` exists for tests, the bench and
the examples; on a cluster the caller brings a configured session.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job of this package relies on.  Timestamps at rest are
# TIMESTAMP_NTZ meaning UTC; a UTC session zone keeps the few conversions to
# TIMESTAMP (needed by watermarks) exact.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE turns a sort-merge join into a broadcast join only when the
    # measured size of one side stays below this bound.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    # sketch aggregates keep up to 1024 groups per task in a hash map (a few
    # MB of KLL sketches) before falling back to sort-based aggregation
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1024",
}


def cluster_conf(shuffle_bytes_estimate: int, executor_cores_total: int) -> dict[str, str]:
    """Settings to pass to ``spark-submit`` for a large cluster run.

    Shuffles start with enough partitions for ~128 MB each (at least 3× the
    cores) and AQE coalesces small ones at run time; file splits are 256 MB
    so a 100 TB scan is ~400k tasks of bounded memory; skewed partitions
    (5× the median and over 256 MB) are split by AQE."""
    target = 128 * 1024 * 1024
    parts = max(3 * executor_cores_total, -(-shuffle_bytes_estimate // target))
    return {
        **CORE_CONF,
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16m",
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
        "spark.sql.parquet.aggregatePushdown": "true",
    }


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "nightjar") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for k, v in CORE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_core_conf(spark: SparkSession) -> None:
    """Set the runtime SQL settings the operators assume, where the caller has
    not set them (only the session time zone is needed for right results)."""
    for k, v in CORE_CONF.items():
        if k == "spark.sql.session.timeZone" or spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared file system folder and is left
    as it is.  Only when it is unset (tests, a laptop) a fresh scratch folder
    is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="nightjar-ckpt-", dir=os.environ.get("NIGHTJAR_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder (streaming checkpoints,
    materialised intermediate tables)."""
    return os.path.join(ensure_checkpoint_dir(spark), name)
