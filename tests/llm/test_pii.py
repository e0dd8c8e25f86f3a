import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from nightjar.llm import pii
from nightjar.llm.pii import add_spans, base_only, listed, luhn, redact

# the contract's patterns, over the whole text
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

PARTS = ["a", "b.c", "@", "@x", "é", ".", "..", "-", "+", "+1", " ", " ", "(", ")", "1", "22", "333", "255", "256", "0",
         "1.2.3.4", "10.0.0.1", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 555-0142", "mail9.example.com",
         "me@mail.example.org", "://", "http://u:p@h.com/", "x (at) y.org", "[at]", "account", "IBAN ", "\n", "👍", "%",
         "GB82 WEST 1234 5698 7654 32", "0000000000000000000", "999.1.1.1", "1.1.1", "007.08.9.1"]


def brute(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_are_the_patterns(seed):
    automaton = pii._anchors()
    for t in texts(4000, seed):
        assert [s for s in pii.spans(t, automaton) if s[1] < 4] == brute(t), t


def test_dense_alphabet():
    rnd, automaton = random.Random(9), pii._anchors()
    for _ in range(20_000):
        t = "".join(rnd.choice("01 .-+@a()") for _ in range(rnd.randint(0, 40)))
        assert [s for s in pii.spans(t, automaton) if s[1] < 4] == brute(t), t


def found(text):
    return [(pii.KINDS[k], text[s:e]) for s, k, e in pii.spans(text, pii._anchors()) if k > 3]


def test_added_spans():
    assert found("write to jo.do (at) mail.example.com now") == [("masked", "jo.do (at) mail.example.com")]
    assert found("jo[at]example[dot]org") == [("masked", "jo[at]example[dot]org")]
    assert found("see ftp://me:secret@host.example/x") == [("url", "ftp://me:secret@host.example")]
    assert found("see https://example.com/a?b=c") == []
    assert found("IBAN: GB82 WEST 1234 5698 7654 32.") == [("account", "GB82 WEST 1234 5698 7654 32")]
    assert found("IBAN: GB83 WEST 1234 5698 7654 32.") == []
    assert found("Account no. 12-345678") == [("account", "12-345678")]
    assert found("by all accounts 12345678") == [] == found("account 12345")
    assert found("account 4111111111111111") == []  # a base span already


def test_linear_on_long_runs():
    automaton = pii._anchors()
    for t in ("1" * 300_000, "1." * 150_000, "a" * 300_000 + "@" * 1000, "+1 (" * 80_000, "a@" * 100_000,
              "0" * 9000 + ".1.1.1", "account" * 40_000, "((at)" * 60_000):
        pii.spans(t, automaton)
    assert pii.spans("0" * 9000 + ".1.1.1", automaton)[0] == (0, 1, 9006)


def test_query_columns_against_brute_force(make_docs):
    rows = [(i, t) for i, t in enumerate(texts(60, 7))] + [
        (100, None), (101, ""), (None, "a@b.c"), (5, "a@b.c"), (5, "a@b.c"), (102, "x " * 300_000 + "é a@b.c")]
    df = make_docs(rows).selectExpr("*", "1 as kind", "2 as start", "3 as `end`", "'y' as spans")
    out = add_spans(df)
    assert out.columns == [c for c in df.columns if c != "spans"] + ["spans"]
    got = out.select("text", "kind", listed(base_only(F.col("spans"))).alias("base"),
                     F.sha2(listed(base_only(F.col("spans"))), 256).alias("sha")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute(r.text))
        assert (r.base, r.kind, r.sha) == (want, 1, hashlib.sha256(want.encode()).hexdigest())
    assert "text" not in add_spans(df, keep_text=False).columns
    assert add_spans(df.limit(0)).count() == 0


def test_registered_query(spark):
    """The query's counts and digests over a whole table."""
    from nightjar.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = QUERIES["op11_anchor_expansion"][0](spark, sf).collect()
    assert len(out) == len(text)
    for r in out:
        want = brute(text[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",")) <= set(r.spans.split(","))


def test_redact(make_docs):
    rows = [(1, "é write me@x.org or +1 (555) 555-0142!"), (2, None), (3, "none"), (4, "1.2.3.4 1.2.3.4")]
    out = {r.doc_id: r.text for r in redact(add_spans(make_docs(rows))).collect()}
    assert out == {1: "é write <email> or <phone>!", 2: None, 3: "none", 4: "<ip> <ip>"}
