"""Operator 10: BPE encoding and decoding as distributed columns.

``encode`` adds the ids of a text column, ``decode`` the text of an ids
column; both are narrow (no shuffle) and keep every other column.  Cases:
null text encodes to no ids, empty text too; null ids decode to null; rows
are independent, so repeated rows give repeated results; an empty table gives
an empty table; a column already named like the output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.llm.bpe import encoder, offset_table
from nightjar.llm.common import slices


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with one column replaced or added at the end."""
    names = [n for n in batch.schema.names if n != name]
    return pa.record_batch([*(batch.column(n) for n in names), values], names=[*names, name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add ``ids_col``: ids of the text under the vocabulary file's merges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, text_col):
                packed = [coder.packed(t) for t in part.column(text_col).to_pylist()]
                offsets = np.zeros(len(packed) + 1, dtype=np.int32)
                np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
                ids = np.frombuffer(b"".join(packed), dtype="<i4")
                yield _with(part, ids_col, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, type=pa.int32())))

    return df.mapInArrow(run, _schema(df, ids_col, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add ``text_col``: the ids' bytes joined and read as UTF-8 (broken
    sequences become U+FFFD)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = offset_table(vocabulary)
        for batch in batches:
            # some hundred documents at a time: outputs stay small
            for start in range(0, batch.num_rows, 500):
                part, out = batch.slice(start, 500), []
                for ids in part.column(ids_col):
                    if not ids.is_valid:
                        out.append(None)
                        continue
                    values = ids.values.to_numpy(zero_copy_only=False)
                    out.append(b"".join(table.decode(values)).decode("utf-8", "replace"))
                yield _with(part, text_col, pa.array(out, type=pa.string()))

    return df.mapInArrow(run, _schema(df, text_col, T.StringType()))


def token_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: token count, digest of the ids, digest of the round trip."""
    coded = decode(encode(docs.select("doc_id", "text"), vocabulary), vocabulary)
    return coded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
