"""SC-1 / SC-2: RFC 3164 syslog parsing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar import schemas
from nightjar.functions.scalars import ColumnOrName, _col, js_trim

def _names(values: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in values])


def _groups(text: Column, pat: str) -> Column:
    """Groups 1, 3, 4 and 5 of the pattern as an array, by one replacement that
    joins them with U+0001; a text that holds U+0001 itself is taken apart
    group by group."""
    joined = F.split(F.regexp_replace(text, pat, "$1\u0001$3\u0001$4\u0001$5"), "\u0001", -1)
    apart = F.array(*[F.regexp_extract(text, pat, i) for i in (1, 3, 4, 5)])
    return F.when(text.contains("\u0001"), apart).otherwise(joined)


def parse_syslog(raw: ColumnOrName) -> Column:
    """struct(facility, severity, host, tag, message) or null when the trimmed
    line does not match the RFC 3164 header pattern.

    The pattern runs once to test and once to pull all groups out together,
    instead of one regex evaluation per field."""
    text = js_trim(_col(raw))
    pat = schemas.SYSLOG_PATTERN
    parts = _groups(text, pat)
    pri = parts[0].cast("int")
    parsed = F.struct(
        # Codes past the table (pri >= 192) have no facility name.
        F.coalesce(F.get(_names(schemas.SYSLOG_FACILITIES), F.floor(pri / 8).cast("int")), F.lit("unknown")).alias("facility"),
        F.coalesce(F.get(_names(schemas.SYSLOG_SEVERITIES), pri % 8), F.lit("unknown")).alias("severity"),
        parts[1].alias("host"),
        js_trim(parts[2]).alias("tag"),
        parts[3].alias("message"),
    )
    return F.when(text.rlike(pat), parsed)


def syslog_payload(parsed: ColumnOrName, raw: ColumnOrName) -> Column:
    """SC-2: JSON text of the parsed fields plus the raw line, in that key order."""
    p = _col(parsed)
    return F.when(
        p.isNotNull(),
        F.to_json(F.struct(p["facility"].alias("facility"), p["severity"].alias("severity"),
                           p["host"].alias("host"), p["tag"].alias("tag"), p["message"].alias("message"),
                           _col(raw).alias("raw"))),
    )


def with_parsed_syslog(df: DataFrame, raw_col: str = "raw", out: str = "parsed") -> DataFrame:
    """``df`` plus a ``parsed`` struct column (SC-1), computed in stages so the
    trimmed text and the extracted groups are evaluated once per row (the
    optimizer keeps a costly expression in its own projection rather than
    copying it into every field)."""
    pat = schemas.SYSLOG_PATTERN
    staged = (df.withColumn("_sl_text", js_trim(F.col(raw_col)))
              .withColumn("_sl_ok", F.col("_sl_text").rlike(pat))
              .withColumn("_sl_parts", _groups(F.col("_sl_text"), pat)))
    parts = F.col("_sl_parts")
    pri = parts[0].cast("int")
    parsed = F.struct(
        F.coalesce(F.get(_names(schemas.SYSLOG_FACILITIES), F.floor(pri / 8).cast("int")), F.lit("unknown")).alias("facility"),
        F.coalesce(F.get(_names(schemas.SYSLOG_SEVERITIES), pri % 8), F.lit("unknown")).alias("severity"),
        parts[1].alias("host"),
        js_trim(parts[2]).alias("tag"),
        parts[3].alias("message"),
    )
    return staged.withColumn(out, F.when(F.col("_sl_ok"), parsed)).drop("_sl_text", "_sl_ok", "_sl_parts")
