import random
import re

import pytest

from nightjar.llm.first_seen import NULL_ID
from nightjar.llm.substring import remove_repeats

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window):
    """doc_id, n_words, n_removed, kept words joined, by the definition."""
    first, words = {}, []
    for d, t in rows:
        w = WORD.findall(t or "")
        words.append((d, w))
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            at = (float("inf") if d is None else d, p)
            first[k] = min(first.get(k, at), at)
    out = []
    for d, w in words:
        gone, mine = set(), set()
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            if first[k][0] < (float("inf") if d is None else d) or k in mine:
                gone.update(range(p, p + window))
            mine.add(k)
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.text or "") for r in df.collect()], key=str)


@pytest.mark.parametrize("seed,window,words", [(1, 8, 2), (2, 8, 4), (3, 20, 2), (4, 10, 1), (5, 12, 30)])
def test_against_brute_force(make_docs, tangled, seed, window, words):
    rows = list(enumerate(tangled(seed, words=words)))
    assert got(remove_repeats(make_docs(rows), window, layout=False)) == brute(rows, window)


def test_edge_rows(make_docs):
    p = " ".join(f"x{i}" for i in range(25))
    rows = [(5, p), (3, None), (4, ""), (None, p + " tail"), (9, "é ß " + p), (9, p), (12, p + " " + p), (1, "a b")]
    assert got(remove_repeats(make_docs(rows), 20, layout=False)) == brute(rows, 20)
    out = {r.doc_id: r for r in remove_repeats(make_docs(rows), 20).where("doc_id in (5, 12)").collect()}
    assert out[5].text == p and out[12].text == "" and out[12].n_removed == 50


def test_factors_point_to_their_source(make_docs):
    body = " ".join(f"x{i}" for i in range(200))
    rows = [(1, "a b c " + body), (2, "q " + body + " z")]
    factors = remove_repeats(make_docs(rows)).where("doc_id = 2").collect()[0].factors
    assert len(factors) == 1 and factors[0].length > 150
    assert factors[0].ref_doc == 1 and factors[0].ref_start == factors[0].start + 2


def test_empty_table_and_clashing_columns(spark, make_docs):
    assert remove_repeats(make_docs([(1, "a")]).limit(0)).count() == 0
    df = make_docs([(1, "a b")]).selectExpr("*", "1 as n_words", "'x' as _doc", "2 as _refs", "3 as pos")
    row = remove_repeats(df).collect()[0]
    assert row.n_words == 2 and row["_doc"] == "x" and row.pos == 3 and row.text == "a b"


def test_very_long_text(make_docs):
    body = " ".join(f"t{i}" for i in range(400_000))
    rows = [(1, body), (2, body + " end"), (3, "t5 " * 10)]
    out = {r.doc_id: (r.n_words, r.n_removed) for r in
           remove_repeats(make_docs(rows)).select("doc_id", "n_words", "n_removed").collect()}
    assert out == {1: (400_000, 0), 2: (400_001, 400_000), 3: (10, 0)}


def test_layout_is_kept(make_docs):
    p = " ".join(f"x{i}" for i in range(20))
    rows = [(1, p), (2, f"head\n{p}\ntail  end")]
    out = {r.doc_id: r.text for r in remove_repeats(make_docs(rows)).collect()}
    assert out == {1: p, 2: "head\ntail  end"}


def _third_null_third_one_id(n=3000):
    """A third of the rows has no id, another third one id; texts repeat."""
    rnd = random.Random(6)
    shared = [" ".join(f"p{j}x{k}" for k in range(30)) for j in range(5)]
    rows = []
    for i in range(n):
        own = " ".join(f"q{rnd.randint(0, 10**6)}" for _ in range(12))
        text = own + " " + rnd.choice(shared) if i % 4 else rnd.choice(shared)
        rows.append((None if i % 3 == 0 else 7 if i % 3 == 1 else 100 + i, text))
    return rows


def test_many_rows_without_an_id_or_with_one_id(make_docs):
    """Equal to brute force, and a row's entries are bounded by its own
    length however many rows share its id."""
    from pyspark.sql import functions as F

    from nightjar.llm.substring import references
    rows = _third_null_third_one_id()
    docs = make_docs(rows)
    assert got(remove_repeats(docs, 8, layout=False)) == brute(rows, 8)
    plain = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), F.hash("text").alias("th"), "text")
    most = (references(plain, 8).groupBy("doc", "th").agg(F.size(F.collect_set(F.struct("pos", "tag", "rdoc", "rpos", "same")))
            .alias("n")).agg(F.max("n")).first()[0])
    assert most <= 2 * max(len(t.split()) for _, t in rows)
