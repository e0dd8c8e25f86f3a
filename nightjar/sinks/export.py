"""CSV / JSON export (SNK-1, SNK-2).

Exports are distributed writes (one part file per task, each with its header);
nothing is gathered on the driver.  Values are normalised first so the files
read as the reference's: ISO timestamps with ms and ``Z``, arrays joined with
``,``, nulls as empty cells, quotes only where needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.functions.scalars import iso_utc

EXPORT_ENTITIES = ("alerts", "incidents", "vulnerabilities", "assets")


def _cells(df: DataFrame, join_arrays: bool = True) -> list[Column]:
    """The columns as exported."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = iso_utc(c)
        elif join_arrays and isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        cols.append(c.alias(f.name))
    return cols


def _csv_line(cells: list[Column]) -> Column:
    def cell(c: Column) -> Column:
        s = F.coalesce(c.cast("string"), F.lit(""))
        needs = s.rlike('[",\n]')
        return F.when(needs, F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)
    return F.concat_ws(",", *[cell(c) for c in cells])


def export_rows(df: DataFrame, order_col: str = "created_at", join_arrays: bool = True) -> DataFrame:
    """Rows as exported: newest first (id breaks ties), timestamps as ISO
    text, arrays joined with ``,`` for CSV (JS ``String(array)``)."""
    cols = _cells(df, join_arrays)
    order = [F.desc(order_col)] if order_col in df.columns else []
    if "id" in df.columns:
        order.append(F.asc("id"))
    out = df.select(*cols)
    return out.orderBy(*order) if order else out


def export_csv(df: DataFrame, path: str, order_col: str = "created_at") -> None:
    """SNK-1: header = column names, null → empty, quote only text holding
    ``"``, ``,`` or a newline, ``"`` doubled.  Empty input writes no part."""
    rows = export_rows(df, order_col)
    if df.isEmpty():  # one limit-1 probe of the unsorted input; Spark would write a header-only part
        rows.sparkSession.createDataFrame([], "value string").write.mode("overwrite").text(path)
        return
    (rows.write.mode("overwrite")
     .option("header", True).option("quote", '"').option("escape", '"')
     .option("emptyValue", "").option("nullValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("lineSep", "\n")
     .csv(path))


def export_csv_lines(df: DataFrame, path: str, order_col: str = "created_at") -> None:
    """SNK-1 as one file in parts: the header is the first line of the first
    part only, and the parts, one after another, are the rows in export order.
    The write replaces what an earlier attempt left."""
    names = df.columns
    keys = [F.col(f"`{order_col}`").desc()] if order_col in names else []
    keys += [F.asc("id")] if "id" in names else []
    # the order is that of the values, the line that of their text
    lines = df.select(F.lit(1).alias("_part"), *[F.col(f"`{c}`") for c in names], _csv_line(_cells(df)).alias("_line"))
    header = df.sparkSession.range(1).select(
        F.lit(0).alias("_part"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields],
        _csv_line([F.lit(c) for c in names]).alias("_line"))
    (header.union(lines).orderBy("_part", *keys).select(F.col("_line").alias("value"))
     .write.mode("overwrite").text(path))


def export_json(df: DataFrame, path: str, order_col: str = "created_at") -> None:
    """SNK-2: the same rows as JSON objects, nulls kept, arrays as arrays.  The alerts export
    carries no technique ids (drop them before calling)."""
    (export_rows(df, order_col, join_arrays=False).write.mode("overwrite").option("ignoreNullFields", "false").json(path))


def csv_text(df: DataFrame) -> DataFrame:
    """One CSV line per row, as text (SC-13), for checks and small previews;
    quoting rule identical to ``export_csv``."""
    return df.select(_csv_line([F.col(f"`{c}`") for c in df.columns]).alias("line"))


def export_report(tables: dict[str, DataFrame], entity: str, fmt: str, path: str) -> None:
    """The export route: ``entity`` in alerts / incidents / vulnerabilities /
    assets, ``fmt`` csv (default) or json; alerts are exported without their
    technique ids."""
    if entity not in EXPORT_ENTITIES:
        raise ValueError(f"cannot export {entity!r}")
    df = tables[entity]
    if entity == "alerts" and "mitre_technique_ids" in df.columns:
        df = df.drop("mitre_technique_ids")
    if fmt == "json":
        export_json(df, path)
    elif fmt == "csv":
        export_csv(df, path)
    else:
        raise ValueError("format must be 'csv' or 'json'")
