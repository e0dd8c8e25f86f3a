"""Scalar functions (SC-*), all native Column expressions (no Python UDF)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from nightjar import schemas

ColumnOrName = Column | str

def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_values(c: ColumnOrName, mapping: Mapping, default=None) -> Column:
    """SC-18: a ``CASE`` chain built from a Python dict (stays in codegen)."""
    c = _col(c)
    out = None
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default))


def enum_rank(c: ColumnOrName, domain: Sequence[str]) -> Column:
    """SO-4: position of an enum value in its declaration order (unknown → null)."""
    return map_values(c, {v: i for i, v in enumerate(domain)})


def severity_rank(c: ColumnOrName) -> Column:
    return enum_rank(c, schemas.SEVERITIES)


# The characters JavaScript's String.prototype.trim removes —
# WhiteSpace (TAB, VT, FF, SP, NBSP, ZWNBSP and every Zs space separator) and
# LineTerminator (LF, CR, LS, PS).
JS_WHITESPACE = ("\t\n\u000b\u000c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
                 "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff")


def js_trim(c: ColumnOrName) -> Column:
    """SC-3: strip every leading/trailing whitespace character (JS ``trim``);
    Spark's ``trim`` strips spaces only.  A character-set ``btrim`` (a plain
    scan, no regex)."""
    return F.btrim(_col(c), F.lit(JS_WHITESPACE))


def iso_utc(c: ColumnOrName) -> Column:
    """SC-12: ISO-8601 text with milliseconds and ``Z``."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def utc_day(c: ColumnOrName) -> Column:
    """SC-7: ``YYYY-MM-DD`` of the UTC day."""
    return F.date_format(_col(c), "yyyy-MM-dd")


def dow_sunday0(c: ColumnOrName) -> Column:
    """SC-8: day of week with Sunday = 0."""
    return (F.dayofweek(_col(c)) - 1).cast("int")


def hour_of_day(c: ColumnOrName) -> Column:
    return F.hour(_col(c)).cast("int")


def round_half_up(c: ColumnOrName) -> Column:
    """SC-9: ``Math.round`` on doubles (values here are never negative)."""
    return F.round(_col(c).cast("double"), 0)


def from_suffix(ip: ColumnOrName) -> Column:
    """SC-6: ``" from <ip>"`` when the ip is a non-empty string, else ``""``."""
    ip = _col(ip)
    return F.when(F.length(ip) > 0, F.concat(F.lit(" from "), ip)).otherwise(F.lit(""))


def stable_id(*cols: ColumnOrName) -> Column:
    """SC-17: deterministic id (hex SHA-256) of the given values; safe under
    task retries and replayed micro-batches, unlike ``uuid()``."""
    parts = [F.coalesce(_col(c).cast("string"), F.lit("\u0000")) for c in cols]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def id_prefix(c: ColumnOrName, n: int = 8) -> Column:
    """SC-14: first ``n`` characters of an id."""
    return F.substring(_col(c).cast("string"), 1, n)


def humanize(c: ColumnOrName) -> Column:
    """SC-14: ``snake_case`` label → words (``_`` → space)."""
    return F.replace(_col(c), F.lit("_"), F.lit(" "))


def ts_literal(value: dt.datetime | str) -> Column:
    """A TIMESTAMP_NTZ literal (``as_of`` parameters are plain values, never
    ``current_timestamp()``, so plans are repeatable)."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    return F.lit(value.replace(tzinfo=None)).cast("timestamp_ntz")


def days_before(as_of: dt.datetime | str, days: int) -> Column:
    """F-4: the rolling lower bound ``as_of - days·24h`` folded to a literal."""
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    return ts_literal(as_of - dt.timedelta(days=days))


def check_range(name: str, value: int, lo: int, hi: int) -> int:
    """Parameter validation shared by the operators (§1.4)."""
    if not isinstance(value, int) or isinstance(value, bool) or not lo <= value <= hi:
        raise ValueError(f"{name} must be an integer in [{lo}, {hi}], got {value!r}")
    return value


def keep_rows(df, cond: Column):
    """Keep rows where ``cond`` holds, evaluated on top of the projection that
    computes it.  A ``where`` would be pushed below that projection with the
    whole (costly) expression copied into the filter, so it would run twice;
    a generator over a conditional one-element array drops the rows instead
    (the optimizer infers no pushed-down filter from a generator whose input
    is an expression)."""
    return df.select("*", F.explode(F.when(cond, F.array(F.lit(1)))).alias("_keep")).drop("_keep")


def payload_text(payload: ColumnOrName) -> Column:
    """SC-4: the text rules are matched against is the payload's JSON text as
    stored (keys, quotes, escapes and key order included).  Re-serialising a
    parsed payload would reorder keys or drop nulls and change matches, so
    the stored string is used as is."""
    return _col(payload).cast("string")


def clamp(c: ColumnOrName, lo=None, hi=None) -> Column:
    """SC-10: ``min(hi, max(lo, c))`` with either bound optional."""
    out = _col(c)
    if lo is not None:
        out = F.greatest(F.lit(lo), out)
    if hi is not None:
        out = F.least(F.lit(hi), out)
    return out


def nullish_coalesce(*cols: ColumnOrName) -> Column:
    """SC-11: ``a ?? b ?? …`` — falls through on null only, never on ``''``
    or 0 (for JSON values use ``sources.upload.source_ip_from_json``, which
    also treats a JSON null as absent)."""
    return F.coalesce(*[_col(c) for c in cols])


def array_size(c: ColumnOrName) -> Column:
    """SC-15: number of items (``[]`` → 0, null → 0)."""
    return F.coalesce(F.size(_col(c)), F.lit(0))


def has_item(c: ColumnOrName, item) -> Column:
    """SC-15: membership test on an array column."""
    return F.coalesce(F.array_contains(_col(c), item), F.lit(False))


def map_items(c: ColumnOrName, fn) -> Column:
    """SC-15: apply ``fn`` (Column -> Column) to every item (``transform``)."""
    return F.transform(_col(c), fn)


def json_field(c: ColumnOrName, path: str) -> Column:
    """SC-16: a field of JSON text by JSONPath (``$.level``), null when absent."""
    return F.get_json_object(_col(c), path)


def variant_field(c: ColumnOrName, path: str, type_: str = "string") -> Column:
    """SC-16: parse JSON text once into VARIANT and read a typed field
    (null when absent or of another type)."""
    return F.try_variant_get(F.try_parse_json(_col(c)), path, type_)
