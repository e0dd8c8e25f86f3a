import random
import re

import pytest

import nightjar.llm.ngram_join as N
from nightjar.llm.components import components
from nightjar.llm.ngram_join import near_duplicates

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and den * len(x & y) >= num * len(x | y):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted([(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))],
                  key=str)


def got(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()], key=str)


def family(seed, bases=12, copies=8, length=80):
    """Texts with few edits against a base, near the threshold and over it,
    and a passage that all of them share."""
    rnd, out = random.Random(seed), []
    passage = [f"p{i}" for i in range(30)]
    for b in range(bases):
        base = [f"b{b}w{rnd.randint(0, 400)}" for _ in range(rnd.randint(5, length))]
        for _ in range(rnd.randint(1, copies)):
            t = list(base)
            for _ in range(rnd.randint(0, 6)):
                t[rnd.randrange(len(t))] = f"e{rnd.randint(0, 9)}"
            if rnd.random() < 0.4:
                t += passage
            out.append(" ".join(t))
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("seed,k,num,den", [(1, 4, 85, 100), (2, 5, 4, 5), (3, 4, 1, 2)])
def test_against_brute_force(make_docs, seed, k, num, den):
    rows = list(enumerate(family(seed)))
    assert got(near_duplicates(make_docs(rows), k, num, den)) == brute(rows, k, num, den)


def test_hot_groups_are_split_exactly(make_docs, monkeypatch):
    """Tiny tiles and chunks: every split path runs and loses no link."""
    monkeypatch.setattr(N, "TILE", 5)
    monkeypatch.setattr(N, "CHUNK", 4)
    monkeypatch.setattr(N, "HOT", 3)
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(rnd.randint(0, 9)):
            t[rnd.randrange(len(t))] = f"x{rnd.randint(0, 30)}"
        rows.append((i, " ".join(t)))
    rows += [(100 + i, t) for i, t in enumerate(family(6, bases=4))]
    assert got(near_duplicates(make_docs(rows), 4, 85, 100)) == brute(rows, 4, 85, 100)


def test_edge_rows(make_docs):
    p = " ".join(f"w{i}" for i in range(50))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a B"), (6, "a b c d"), (None, p), (8, p), (8, p + " z"),
            (None, "only me here now and then"), (9, p.upper()), (10, "ä Ä x y"), (11, "ä ä x y")]
    df = make_docs(rows).selectExpr("*", "1 as n", "2 as root", "3 as shingle")
    assert got(near_duplicates(df)) == brute(rows, 4, 85, 100)
    assert near_duplicates(make_docs(rows).limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == ({i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200})


def test_many_rows_without_an_id_or_with_one_id(make_docs):
    """A third of 3,000 rows has no id and a third one id; equal to brute
    force, and the exact check reads a class once, not once per row of its id."""
    rnd = random.Random(6)
    bases = [[f"b{j}w{k}" for k in range(25)] for j in range(200)]
    rows = []
    for i in range(3000):
        t = list(rnd.choice(bases))
        if rnd.random() < 0.5:
            t[rnd.randrange(25)] = f"edit{rnd.randint(0, 3)}"
        rows.append((None if i % 3 == 0 else 7 if i % 3 == 1 else 100 + i, " ".join(t)))
    assert got(near_duplicates(make_docs(rows), 2, 3, 4)) == brute(rows, 2, 3, 4)
