"""File sources: CSV uploads (SRC-1), JSON uploads (SRC-2), syslog text
(SRC-3) and JSON log lines (SRC-7).

All readers are plain ``spark.read`` scans, so a folder of many files is read
by many tasks; no file is ever loaded on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.functions.scalars import keep_rows
from nightjar.functions.syslog import with_parsed_syslog


# Marks a quoted empty field while reading (an unquoted one reads as null),
# so a lone "" record can be told from a ",," record.
_QUOTED_EMPTY = "\u0000nightjar-empty\u0000"


def read_csv_events(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: RFC 4180 records, header row, every value a string.

    Missing cells read as ``''`` (not null); quoted commas, doubled quotes,
    quoted newlines and CRLF / CR line ends are kept by the CSV reader.  When a
    header repeats a name, the last cell of that name wins.  Blank lines, a
    record that is one (quoted) empty field and header-only files give no
    rows; ``,,`` is a row of empty strings.  (A record ``"",,`` reads like a
    lone ``""`` and is dropped too — the one case the reader cannot tell.)"""
    raw = (spark.read.option("header", True).option("multiLine", True).option("quote", '"')
           .option("escape", '"').option("inferSchema", False).option("mode", "PERMISSIVE")
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
           .option("emptyValue", _QUOTED_EMPTY)
           .csv(path))
    cols = raw.columns
    if cols:
        lone_empty = F.col(f"`{cols[0]}`").eqNullSafe(F.lit(_QUOTED_EMPTY))
        for c in cols[1:]:
            lone_empty = lone_empty & F.col(f"`{c}`").isNull()
        raw = raw.where(~lone_empty)
    # Spark renames repeated header names to name<index>; collapse them to the
    # last occurrence under the original name.
    header = _csv_header(spark, path)
    if header is not None and len(header) == len(raw.columns) and len(set(header)) != len(header):
        last = {name: i for i, name in enumerate(header)}
        raw = raw.select(*[F.col(f"`{raw.columns[i]}`").alias(name) for name, i in last.items()])
    return raw.select(*[F.when(F.col(f"`{c}`") == F.lit(_QUOTED_EMPTY), F.lit(""))
                        .otherwise(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in raw.columns])


def _csv_header(spark: SparkSession, path: str) -> list[str] | None:
    """First record of the file(s) as written, read with the same tokeniser."""
    first = (spark.read.option("header", False).option("multiLine", True).option("quote", '"')
             .option("escape", '"').csv(path).limit(1).collect())
    return None if not first else [v if v is not None else "" for v in first[0]]


# A record: unquoted runs and quoted strings (a quote opens a string anywhere,
# one that never closes ends with the text); possessive, so long texts neither
# backtrack nor recurse.
_QUOTED = '"(?:[^"]++|"")*+(?:"|\\z)'
_RECORD = f'((?:[^"\\r\\n]++|{_QUOTED})++)'
_CELL = f',((?:[^",]++|{_QUOTED})*+)'


def csv_records(text: Column) -> Column:
    """The non-blank records of a CSV text, header included, as written."""
    return F.regexp_extract_all(text, F.lit(_RECORD), F.lit(1))


def csv_cells(record: Column) -> Column:
    """The cells of one record, without their quotes."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_CELL), F.lit(1))
    return F.transform(cells, lambda c: F.replace(
        F.regexp_replace(c, '"((?:[^"]++|"")*+)(?:"|\\z)', "$1"), F.lit('""'), F.lit('"')))


def read_csv_files(files: DataFrame) -> DataFrame:
    """SRC-1 for many files, each with its own header, in batch or on a
    stream: ``files`` has one row per file with its whole text in ``value``.

    Returns the other columns with ``n_records`` (of the file), ``ordinal``
    and ``record``: one JSON object per record, keyed by that file's header
    in its order (a repeated name keeps its last cell), missing cells ``''``,
    extra cells dropped.  Blank lines and a record that is one empty cell
    give no row; a text that begins with a line end has the header ``""``.
    A file is one row, so it is bounded by what a row may hold (2 GB)."""
    kept = [c for c in files.columns if c != "value"]
    records = csv_records(F.coalesce("value", F.lit("")))
    blank_first = F.col("value").rlike("^[\\r\\n]")
    split = files.select(*kept, F.when(blank_first, F.concat(F.array(F.lit('""')), records)).otherwise(records)
                         .alias("_records"))
    named = split.select(
        *kept, csv_cells(F.get("_records", F.lit(0))).alias("_header"),
        F.filter(F.slice("_records", F.lit(2), F.size("_records")), lambda r: ~r.isin('""', '"')).alias("_rows"))
    keyed = named.select(
        *kept, F.size("_rows").alias("n_records"), F.array_distinct("_header").alias("_names"),
        F.transform(F.array_distinct("_header"),
                    lambda n: (F.size("_header") - F.array_position(F.reverse("_header"), n)).cast("int")).alias("_last"),
        F.posexplode_outer("_rows").alias("ordinal", "_row"))
    # outer, and dropped above: a filter on the size would split the text again
    cells = keyed.where("_row is not null").withColumn("_cells", csv_cells(F.col("_row")))
    return cells.select(*kept, "n_records", "ordinal", F.to_json(F.map_from_arrays(
        "_names", F.transform("_last", lambda i: F.coalesce(F.get(F.col("_cells"), i), F.lit(""))))).alias("record"))


def read_json_events(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """SRC-2: a ``.json`` upload must hold one JSON array of records.

    Returns (file, ordinal, record) with ``record`` the JSON text of each element,
    key order and nulls kept.  Files that are not an array (an object, or
    malformed text) yield one row with ``record`` null and ``rejected`` set.
    ``json_lines=True`` reads one record per line instead, which splits across
    tasks for large inputs."""
    if json_lines:
        lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value"))
        ok = F.from_json("value", "map<string,string>").isNotNull() & F.trim("value").startswith("{")
        return lines.where(F.length(F.trim("value")) > 0).select(
            "file", F.monotonically_increasing_id().alias("ordinal"),
            F.when(ok, F.col("value")).alias("record"), (~ok).alias("rejected"))
    files = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.col("value"))
    # a file of another kind is rejected like a malformed one, not skipped
    arr = F.when(F.lower(F.col("file")).endswith(".json"), F.from_json(F.col("value"), "array<string>"))
    parsed = files.select("file", arr.alias("records"))
    good = parsed.where(F.col("records").isNotNull()).select(
        "file", F.posexplode("records").alias("ordinal", "record"), F.lit(False).alias("rejected"))
    bad = parsed.where(F.col("records").isNull()).select(
        "file", F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("string").alias("record"),
        F.lit(True).alias("rejected"))
    return good.unionByName(bad)


def read_syslog(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3 (batch): one raw line per row plus the parsed header; lines that
    do not parse are dropped."""
    lines = spark.read.text(path).select(F.col("value").alias("raw"))
    return keep_rows(with_parsed_syslog(lines), F.col("parsed").isNotNull())


def read_json_logs(spark: SparkSession, path: str, service: str | None = None,
                   level: str | None = None) -> DataFrame:
    """SRC-7: single-line JSON logs; lifts ``level``/``msg`` into columns and the
    container name (text after the first ``/`` of ``container``).  Label
    filters apply before parsing the rest of the record."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    out = lines.select(
        "line",
        F.get_json_object("line", "$.level").alias("level"),
        F.get_json_object("line", "$.msg").alias("msg"),
        F.regexp_extract(F.coalesce(F.get_json_object("line", "$.container"), F.lit("")), "/(.*)", 1)
        .alias("container"),
        F.get_json_object("line", "$.service").alias("service"),
    )
    if service is not None:
        out = out.where(F.col("service") == service)
    if level is not None:
        out = out.where(F.col("level") == level)
    return out
