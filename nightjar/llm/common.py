"""Helpers shared by the operators: work tables, batch slicing, names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.session import ensure_checkpoint_dir

#: Text bytes that one numpy step works on; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it back.

    Every executor sees the files, so a lost executor costs a re-read only.
    ``narrow`` is for tables of a few bytes a row, such as edges: as many
    files as there are cores instead of one per shuffle partition."""
    path = work_folder(df.sparkSession, name)
    (df.coalesce(df.sparkSession.sparkContext.defaultParallelism) if narrow else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the DataFrame does not have (any case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of a table whatever else it holds."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))


def slices(batch: pa.RecordBatch, text_col: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch holding at most ``limit`` bytes of text
    (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def emit(columns: dict, types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([columns[k] if isinstance(columns[k], pa.Array) else pa.array(columns[k], type=t)
                            for k, t in types.items()], names=list(types))
