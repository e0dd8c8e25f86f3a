"""Shared by the tests: small tables and files."""

import datetime as dt
import os

SF_SMALL = "/root/testdata/sf0.001"


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def write_text(folder: str, name: str, text: str) -> str:
    path = os.path.join(folder, name)
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


def mk(spark, entity: str, rows: list[dict]):
    """A domain table with the entity's schema; absent columns are null
    (arrays empty)."""
    from pyspark.sql import types as T

    from nightjar.schemas import ENTITY_SCHEMAS
    schema = ENTITY_SCHEMAS[entity]
    data = []
    for r in rows:
        vals = []
        for f in schema.fields:
            v = r.get(f.name)
            if isinstance(v, str) and isinstance(f.dataType, T.TimestampNTZType):
                v = ts(v)
            if v is None and isinstance(f.dataType, T.ArrayType):
                v = []
            vals.append(v)
        data.append(tuple(vals))
    def kind(f, i):
        """Ids may be given as numbers, as the driver's tables have them."""
        numbers = any(isinstance(v[i], int) and not isinstance(v[i], bool) for v in data)
        return T.LongType() if numbers and isinstance(f.dataType, T.StringType) else f.dataType
    nullable = T.StructType([T.StructField(f.name, kind(f, i), True) for i, f in enumerate(schema.fields)])
    return spark.createDataFrame(data, nullable)
