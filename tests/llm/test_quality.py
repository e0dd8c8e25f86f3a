import random
import re
from collections import Counter

import pytest

from nightjar.llm.quality import ON_BAD, ON_GOOD, PRIOR, RULES, estimate, judge, measures, posterior

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    cover = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))


ROWS = ["", None, " \n\t", "a b", "x " * 8, "x " * 9, "a b c d e f g h " * 2, "one\none\n one\n\none", "é ß # < > || 👍 %",
        "p q r s t u v w\n" * 3 + "end", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8", "\x0bsep\x0cby\rother\x1cno"]


def columns(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)


def test_measures_against_brute_force(make_docs, tangled):
    rows = list(enumerate([*ROWS, *tangled(3, words=2), *tangled(4, words=40)]))
    out = {r.doc_id: columns(r) for r in measures(make_docs(rows)).collect()}
    assert out == {d: brute(t) for d, t in rows}


def test_long_text(make_docs):
    t = "\n".join(f"w{i} w{i % 100}" for i in range(150_000)) + " x" * 20
    r = measures(make_docs([(1, t)])).drop("text").collect()[0]
    assert columns(r) == brute(t)


def test_estimate_recovers_accuracies():
    rnd, counts = random.Random(1), Counter()
    true = [(0.95, 0.6), (0.9, 0.7), (0.8, 0.4), (0.7, 0.7), (0.9, 0.9), (0.85, 0.8), (0.95, 0.3), (0.99, 0.5),
            (0.9, 0.2), (0.97, 0.8)]
    for _ in range(20_000):
        good = rnd.random() < 0.8
        counts[tuple(0 if rnd.random() < 0.3 else (1 if (rnd.random() < (g if good else 1 - b)) else -1)
                     for g, b in true)] += 1
    prior, accuracy = estimate(sorted(counts.items()))
    assert prior == pytest.approx(0.8, abs=0.02)
    for (g, b), (eg, eb) in zip(true, accuracy, strict=True):
        assert eg == pytest.approx(g, abs=0.03) and eb == pytest.approx(b, abs=0.05)
    assert estimate([]) == (PRIOR, [(ON_GOOD, ON_BAD)] * len(RULES))


def test_judge(make_docs):
    rnd = random.Random(2)
    prose = [" ".join("".join(rnd.choice("abcdeost") for _ in range(rnd.randint(3, 8))) for _ in range(80))
             for _ in range(200)]
    again = ["\n".join([" ".join(t.split()[:16])] * 5) for t in prose[:40]]
    junk = [" ".join(x + "&&&" for x in t.split()) for t in prose[40:80]]
    rows = list(enumerate([*prose, *again, *junk, None, "", "short text", "same words again and again here now " * 30]))
    out = {r.doc_id: r for r in judge(make_docs(rows).selectExpr("*", "1 as n_words", "2 as vote_short")).collect()}
    assert all(out[i].kept for i in range(200))
    assert not any(out[i].kept for i in range(200, 280))
    for d, t in rows:
        n, *_, repeat = brute(t)
        assert out[d].base_failed == (n < 20 or 100 * repeat > 30 * n)
        votes = tuple(out[d][f"vote_{r[0]}"] for r in RULES)
        assert set(votes) <= {-1, 0, 1}
    assert judge(make_docs(rows).limit(0)).count() == 0
    assert 0 < posterior((0,) * len(RULES), 0.8, [(0.8, 0.8)] * len(RULES)) < 1


def test_repeated_and_null_ids(make_docs):
    rows = [(None, "a b"), (1, "x " * 30), (1, "x " * 30), (None, None)]
    assert judge(make_docs(rows)).count() == 4
