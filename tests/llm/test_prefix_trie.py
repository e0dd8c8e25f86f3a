import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from nightjar.llm import prefix_trie as P
from nightjar.llm.prefix_trie import conversation_trie, rebuilt, sequences, trie

WORD = re.compile("[^\x20\x09-\x0d]+")


def rebuild(rows):
    """Rebuilt (role, text) sequences per conversation, by the contract."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute(whole):
    """Every prefix of every conversation, straight from the definition."""
    members = defaultdict(set)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[:len(node)] == node]
        ended = sorted(c for c in own if tuple(whole[c]) == node)
        out.append((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own),
            sum(len(n) == len(node) + 1 for n in below),
            sum(not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in below) for n in below),
            sum((len(members[n]) - 1) * len(WORD.findall(n[-1][1])) for n in below if n),
            hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens,
                    r.ends_sha256) for r in df.collect()], key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def talk(seed, n=60, alphabet=3, longest=6):
    rnd = random.Random(seed)
    said = ["hello there", "a  b\tc", "", "é x"][:alphabet]
    return [(c, t, rnd.choice(["user", "bot"]), rnd.choice(said)) for c in range(n) for t in range(rnd.randint(1, longest))]


@pytest.mark.parametrize("seed,limit", [(1, 1), (2, 12), (3, 1 << 16)])
def test_against_the_definition(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(P, "BLOCK_TURNS", limit)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, str(seed != 2).lower())
    rows = talk(seed)
    assert got(conversation_trie(frame(spark, rows))) == brute(rebuild(rows))
    spark.conf.set(coalesce, before)


def test_one_first_turn_and_one_conversation_for_many(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_TURNS", 8)
    monkeypatch.setattr(P, "ID_RANGE", 16)
    rnd = random.Random(5)
    rows = [(c, 0, "user", "same start") for c in range(300)]
    rows += [(c, 1, "bot", "same reply" if c % 3 else f"reply {rnd.randint(0, 40)}") for c in range(300)]
    rows += [(c, 2, "user", "and on") for c in range(0, 300, 7)]
    assert got(conversation_trie(frame(spark, rows))) == brute(rebuild(rows))


def test_cases(spark):
    rows = [(0, 1, "user", "a"), (0, 0, None, None), (0, None, "user", "first"), (3, 0, "u", "x"), (3, 0, "u", "x"),
            (None, 0, "user", "lost"), (21, 0, "u", "y"), (21, 1, "u", "z"), (22, 0, "user", "q"),
            (45, 0, "u", "deep"), *[(47, i, "u", "turn " * 50) for i in range(300)], (1000, 0, "u", "w " * 100_000)]
    df = frame(spark, rows).selectExpr("*", "1 as key", "2 as part", "3 as first", "4 as seq")
    want = brute(rebuild(rows))
    assert got(conversation_trie(df)) == want
    assert any(r[1] == 0 and r[3] == len({r[0] for r in rows} - {None}) for r in want)
    assert conversation_trie(df.limit(0)).count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    """h turns dropped, no conversation to lend any."""
    c = next(c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "u", "a"), (c, 1, "u", "b")]
    assert got(conversation_trie(frame(spark, rows))) == [
        (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_trie_of_any_sequences(spark):
    rows = talk(8, 40)
    seqs = sequences(frame(spark, rows))
    own = defaultdict(list)
    for c, _, role, text in rows:
        own[c].append((role, text))
    assert got(trie(seqs)) == brute(own)
    assert rebuilt(seqs, span=1, heads=1).count() == seqs.count()
