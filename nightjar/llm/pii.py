"""Operator 11: personal data by anchor expansion.

An Aho-Corasick automaton runs once over a text and finds anchors: at-signs
(plain and spelled out), plus signs and digits, the ``://`` of schemes and the
cue words of identifiers.  From each anchor a local parser reads as far as its
kind allows and validates what it read:

* email: the run of local-part characters before an at-sign, bounded by the
  address before, and the dotted labels after it;
* ip, card, phone: the stretch of number characters from its first digit or
  plus sign; dotted groups are taken by fours, digit chains must have 14 to
  19 digits and pass Luhn, a phone number 10 to 15 digits;
* masked (added): ``name (at) example (dot) org`` and the like;
* url (added): a scheme whose authority holds a user name before an at-sign;
* account (added): after a cue word an IBAN that passes modulo 97, or a chain
  of 6 to 18 digits that is no base span.

The first four kinds equal leftmost non-overlapping matches of their patterns
(``n_email`` and the other counts are of those); work is linear in the length
of the text.

Cases: null and empty texts have no spans; a text is read whole however long;
rows are independent, so ties and repeated rows give repeated results; an
empty table gives an empty table; a column named like the output is replaced,
all others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.llm.common import slices

#: In the order in which spans that start together are listed.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "masked", "url", "account")
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                 T.StructField("end", T.IntegerType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

# Cue words before account numbers (English, German, French, Spanish); fixed values.
CUES = ("iban", "account", "acct", "konto", "kontonummer", "compte", "cuenta", "passport", "reisepass", "pasaporte",
        "ssn", "routing number", "customer id", "steuernummer")
#: Spelled-out at-signs; fixed values.
MASKS = ("(at)", "[at]", "{at}")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_MASKED_DOMAIN = re.compile(r" ?([A-Za-z0-9-]+(?: ?(?:\.|[(\[{]dot[)\]}]) ?[A-Za-z0-9-]+)+)")
_NUMBERS = re.compile(r"[0-9\x20().+-]+")
_GROUPS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AFTER_CUE = re.compile(r"(?:[\x20:#=.-]|no\b|nr\b|number\b|is\b){1,6}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?")
_AUTHORITY = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=:-]+@[A-Za-z0-9.-]+")
#: Longest stretch without a number: "1.1.1.1" has seven characters.
_SHORTEST = 7


def _anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for d in "0123456789+":
        automaton.add_word(d, ("n", 1))
    automaton.add_word("@", ("@", 1))
    automaton.add_word("://", (":", 3))
    for mask in MASKS:
        for m in {mask, mask.upper()}:
            automaton.add_word(m, ("m", len(m)))
    for cue in CUES:
        for c in {cue, cue.upper(), cue.capitalize()}:
            automaton.add_word(c, ("c", len(c)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in map(int, digits[-2::-2]):
        total += 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _stretch(text: str, start: int, end: int, out: list) -> None:
    """Numbers between a first digit or plus sign and the end of its stretch."""
    for m in _GROUPS.finditer(text, start, end):
        if text.find(".", m.start(), m.end()) >= 0:
            at, parts = m.start(), m.group().split(".")
            for i in range(0, len(parts) - 3, 4):
                four = parts[i:i + 4]
                stop = at + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    out.append((at, 1, stop))
                at = stop + 1
    for m in _CHAIN.finditer(text, start, end):
        if m.end() - m.start() >= 14:
            digits = _digits(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if text.find("+", start, end) >= 0:
        for m in _PHONE.finditer(text, start, end):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _account(text: str, cue: int, after: int) -> tuple[int, int] | None:
    if cue and text[cue - 1].isalnum() or after < len(text) and text[after].isalnum():
        return None
    gap = _AFTER_CUE.match(text, after)
    at = gap.end() if gap else after
    if m := _IBAN.match(text, at):
        if _mod97(m.group()):
            return m.start(), m.end()
    elif (m := _CHAIN.match(text, at)) and 6 <= len(_digits(m.group())) <= 18:
        return m.start(), m.end()
    return None


def spans(text: str | None, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of every span, in order."""
    out: list[tuple[int, int, int]] = []
    added: list[tuple[int, int, int]] = []
    read = mailed = 0  # ends of the last stretch of numbers and of the last address
    for last, (kind, size) in automaton.iter(text or ""):
        at = last + 1 - size
        if kind == "n":
            if at >= read:
                read = _NUMBERS.match(text, at).end()
                if read - at >= _SHORTEST:
                    _stretch(text, at, read, out)
        elif kind == "@":
            start = mailed + len(text[mailed:at].rstrip(_LOCAL))
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                out.append((start, 0, m.end()))
                mailed = m.end()
            else:
                mailed = at + 1
        elif kind == "m":
            stop = at - (text[at - 1:at] == " ")
            start = mailed + len(text[mailed:stop].rstrip(_LOCAL))
            if start < stop and (m := _MASKED_DOMAIN.match(text, at + size)):
                added.append((start, 4, m.end()))
        elif kind == ":":
            m = _AUTHORITY.match(text, at + 3)
            start = at - len(text[max(at - 12, 0):at]) + len(text[max(at - 12, 0):at].rstrip(_LOCAL[:52]))
            if m and start < at:
                added.append((start, 5, m.end()))
        elif found := _account(text, at, last + 1):
            added.append((found[0], 6, found[1]))
    if added:
        held = {(s, e) for s, _, e in out}
        out += [x for x in dict.fromkeys(added) if (x[0], x[2]) not in held]
    out.sort()
    return out


def add_spans(df: DataFrame, text_col: str = "text", out_col: str = "spans", keep_text: bool = True) -> DataFrame:
    """Add ``out_col``, an array of (kind, start, end) in code points, end
    exclusive, by start and then kind as listed; without ``keep_text`` the
    text column is left out."""
    kept = [f for f in df.schema.fields if f.name.lower() != out_col.lower() and (keep_text or f.name != text_col)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _anchors()
        for batch in batches:
            for part in slices(batch, text_col):
                found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(t, automaton)]
                         for t in part.column(text_col).to_pylist()]
                yield pa.record_batch([*(part.column(n) for n in names), pa.array(found, type=_ARROW)],
                                      names=[*names, out_col])

    typed = df.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    return typed.mapInArrow(run, T.StructType([*kept, T.StructField(out_col, SPAN)]))


def listed(found: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_only(found: Column) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*BASE))


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``text_col`` with every span replaced by its kind in angle brackets; of
    overlapping spans the first, and of those that start together the
    longest, is replaced, with what the others reach beyond it."""
    text, found = F.col(f"`{text_col}`"), F.col(f"`{spans_col}`")
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        done = F.when(fresh, F.concat(acc["done"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]),
                                      F.lit("<"), s["kind"], F.lit(">"))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text)))
    return df.withColumn(text_col, F.aggregate(found, start, step, finish))
