import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from nightjar.llm import ranked_search as R
from nightjar.llm.ranked_search import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """Every document scored for every item."""
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, Counter(t), len(t)) for d, t in held if t]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        query, scored = terms(text), []
        for d, c, size in held:
            m = 100 - 75 + (75 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m))
                        for w in query if c[w])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()], key=str)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def corpus(seed, n=150):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "THE", "the", "Über", "über", "é_x", "a-b", "中文", "x\x00y"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(rnd.choices(words, weights, k=rnd.randint(0, 40)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_scoring_everything(spark, make_docs, monkeypatch, seed):
    monkeypatch.setattr(R, "BLOCK_DOCS", 16)
    docs = corpus(seed)
    asked = [(i, " ".join(t.split()[:12])) for i, t in corpus(seed + 10, 25)] + [(99, "w1 w1 W1 nowhere"), (100, None)]
    assert got(search(make_docs(docs).repartition(3), items(make_docs(docs).sparkSession, asked))) == brute(docs, asked)


def test_cases(spark, make_docs, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_TERMS", 2)
    docs = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "a b"), (4, "a " * 200_000), (5, "..."), (0, "b a")] + [
        (i, "a b") for i in range(10, 40)]
    asked = [(1, "a"), (2, "b a b"), (2, "b"), (3, ""), (None, "b"), (4, "zzz")]
    df = make_docs(docs).selectExpr("*", "1 as n", "2 as terms", "3 as score", "4 as salt")
    assert got(search(df, items(spark, asked).selectExpr("*", "7 as doc_id", "8 as query"))) == brute(docs, asked)
    assert search(df.limit(0), items(spark, asked)).count() == 0
    assert search(df, items(spark, []), k=10).collect() == []
    assert got(search(df, items(spark, [(1, "a")]), k=3)) == brute(docs, [(1, "a")], 3)


def test_accumulators_are_limited_and_survivors_exact():
    """A block where the rare term's documents alone can be among the best:
    the frequent term creates no accumulator, but adds to theirs."""
    n_docs = 1000
    docs = np.arange(n_docs)
    terms_of = [[0, 1] if d < 20 else [1] for d in docs]
    first = np.append(0, np.cumsum([len(t) for t in terms_of]))
    flat = np.concatenate(terms_of).astype(np.int64)
    block = R.Block(docs, np.full(n_docs, 5), first, flat, np.ones(len(flat), np.int64), n_docs, 5 * n_docs)
    weights = np.array([R.weight(n_docs, 20), R.weight(n_docs, 990)], dtype=np.int64)
    weights[1] = max(weights[1], 3)
    query = R.Query(0, 0, np.array([0, 1]), weights, np.array([20, 990]))
    found, score = block.rank(query, 10, 0)
    assert found.tolist() == list(range(20)) and len(set(score.tolist())) == 1
    gain = (10**9) // (1000 + 8 * 100)
    assert score[0] == gain * int(weights.sum())


def test_blocks_of_queries(spark, make_docs):
    rows = [(i, "a b c") for i in range(10)]
    sizes = [len(b) for b in R.query_blocks(items(spark, rows), "item_id", "text", limit=7)]
    assert sizes == [2] * 5
