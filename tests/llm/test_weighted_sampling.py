import hashlib
import math
import random
import re
from collections import Counter

import pytest
import xxhash

import nightjar.llm.weighted_sampling as W
from nightjar.llm.weighted_sampling import fingerprints

WORD = re.compile("[^\x20\x09-\x0d]+")


def _hash(h, seed):
    """Spark's xxhash64 of one long."""
    return xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed=seed)


def _hash_int(k, seed):
    return xxhash.xxh64_intdigest(k.to_bytes(4, "little"), seed=seed)


def sample(word, weight, k):
    """The textbook form: r, c gamma, beta uniform; a = c / (y e^r)."""
    term = xxhash.xxh64_intdigest(word.encode(), seed=42)
    first = _hash_int(k, _hash(term, 42))
    second = _hash(first, 42)
    u1, u2, u3, u4 = (((h >> s) % 2**32 + 0.5) / 2**32 for h in (first, second) for s in (0, 32))
    r, c, beta = -math.log(u1 * u2), -math.log(u3 * u4), math.log(u2) / math.log(u1 * u2)
    t = math.floor(math.log(weight) / r + beta)
    y = math.exp(r * (t - beta))
    return c / (y * math.exp(r)), t, second


def signature(text):
    bag = Counter(WORD.findall(text))
    return [min((sample(w, n, k), w) for w, n in bag.items())[0][1:] for k in range(W.SAMPLES)] if bag else None


def rows_of(texts):
    """Expected (n_chars, edited) per (id, text), ids ascending, nulls last."""
    order = sorted(set(texts), key=lambda r: (r[0] is None, r[0] or 0))
    out = {}
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        q = len(t) // 4
        out[d] = (len(t), t[:len(t) - q] + n[:q], n)
    return out


def test_against_the_textbook_form(make_docs):
    rnd = random.Random(3)
    texts = [(i, " ".join(rnd.choice(["the", "of", "a", *map(str, range(60))]) for _ in range(rnd.randint(0, 90))))
             for i in range(25)] + [(100, None), (200, "one é ß 👍 two"), (None, "last one of all")]
    want = rows_of(texts)
    out = {r.doc_id: r for r in fingerprints(make_docs(texts)).collect()}
    for d, t in texts:
        n, edited, following = want[d]
        r = out[d]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        mine, other, after = signature(t or ""), signature(edited), signature(following)

        def text(s):
            return "".join(f"{(b ^ t * 0x9E377) & 0xFFFF:04x}" for t, b in s or [])

        def like(a, b):
            if a is None or b is None:
                return float(a is None and b is None)
            return sum(x == y for x, y in zip(a, b)) / W.SAMPLES
        assert (r.fingerprint, r.edited_fingerprint) == (text(mine), text(other))
        assert r.near_edited == pytest.approx(like(mine, other)) and r.near_next == pytest.approx(like(mine, after))


def test_collision_rate_is_generalised_jaccard(make_docs, monkeypatch):
    monkeypatch.setattr(W, "SAMPLES", 512)
    monkeypatch.setattr(W, "signatures", lambda bags, keys, f=W.signatures: f(bags, keys, 512))
    monkeypatch.setattr(W, "likeness", lambda a, b, f=W.likeness: f(a, b, 512))
    x = "a a a a b b c d e f g h i j k l"
    y = "a a b b b c d e f m n o"
    out = {r.doc_id: r for r in fingerprints(make_docs([(1, x), (2, y)])).collect()}
    p, q = Counter(x.split()), Counter(y.split())
    true = sum((p & q).values()) / sum((p | q).values())
    assert out[1].near_next == out[2].near_next == pytest.approx(true, abs=4 * math.sqrt(true * (1 - true) / 512))


def test_edge_rows(make_docs):
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "c"), (4, "w " * 200_000), (5, "q"), (5, "r s t u")]
    df = make_docs(rows).selectExpr("*", "1 as k", "2 as th", "3 as copies", "'z' as term")
    out = fingerprints(df).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(d) for d, _ in rows)
    same = [r for r in out if r.doc_id == 1]
    assert same[0] == same[1] and same[0].fingerprint == same[0].edited_fingerprint
    empty = [r for r in out if r.doc_id in (2, 3)]
    assert [r.fingerprint for r in empty] == ["", ""] and {r.near_edited for r in empty} == {1.0}
    assert fingerprints(make_docs(rows).limit(0)).count() == 0
    one = fingerprints(make_docs([(7, "alone here now")])).collect()[0]
    assert one.near_next == 1.0


def test_no_python_in_the_plan(make_docs):
    plan = fingerprints(make_docs([(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_error_of_the_production_count(make_docs):
    """Neighbours of likeness 0.8 are read with a root mean square error that
    64 samples hold (0.05) and 32 do not (0.071)."""
    rnd, bag, texts = random.Random(11), [f"w{i}" for i in range(90)], []
    for i in range(100):
        bag = bag[10:] + [f"n{i}x{j}" for j in range(10)]
        rnd.shuffle(bag)
        texts.append(" ".join(bag))
    exact = []
    for x, y in zip(texts, texts[1:]):
        p, q = Counter(x.split()), Counter(y.split())
        exact.append(sum((p & q).values()) / sum((p | q).values()))
    assert min(exact) == max(exact) == 0.8
    out = sorted(fingerprints(make_docs(list(enumerate(texts)))).collect(), key=lambda r: r.doc_id)
    error = math.sqrt(sum((r.near_next - s) ** 2 for r, s in zip(out, exact)) / len(exact))
    assert error < 0.06
