import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import nightjar.llm.packing as P
from nightjar.llm.packing import _fullest, _slots, pack, plan
from nightjar.llm.queries import vocabulary_path


def test_fullest_is_the_best_subset_sum():
    rnd = random.Random(1)
    for _ in range(200):
        left = {rnd.randint(1, 30): rnd.randint(1, 4) for _ in range(rnd.randint(1, 8))}
        room = rnd.randint(0, 80)
        best = {0}
        for n, c in left.items():
            best = {s + k * n for s in best for k in range(c + 1) if s + k * n <= room}
        got = _fullest(sorted(left), left, room)
        assert sum(got) == max(best)
        assert all(got.count(n) <= left[n] for n in got)


def test_plan_uses_every_piece_once():
    rnd = random.Random(2)
    counts = {n: rnd.randint(1, 50) for n in rnd.sample(range(1, 200), 60)}
    planned, used = plan(counts, 200), {}
    for pattern, times in planned:
        assert times > 0 and sum(n * k for n, k in pattern.items()) <= 200
        for n, k in pattern.items():
            used[n] = used.get(n, 0) + k * times
    assert used == counts
    bins: list[int] = []  # first fit, longest first
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        at = next((i for i, room in enumerate(bins) if room >= n), None)
        if at is None:
            bins.append(200 - n)
        else:
            bins[at] -= n
    assert sum(t for _, t in planned) <= len(bins)
    assert plan({}, 200) == [] and _slots([], 200) == {}


def check(rows, out, capacity):
    """Every document's tokens once and in order, no gap, no overlap."""
    lib = Tokenizer.from_file(vocabulary_path())
    want = []
    for d, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            want.append((d, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in out)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins), sum(w[3] for w in want)


def test_pack(make_docs, tangled, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_PIECES", 7)  # ranks cross chunks
    rows = list(enumerate(tangled(9, n=80, words=30)))
    rows += [(None, "x"), (500, None), (501, ""), (502, "y z"), (502, "y z"), (503, "many words here " * 3000),
             (504, "<|endoftext|> é")]
    out = pack(make_docs(rows).selectExpr("*", "1 as length", "2 as `row`"), vocabulary_path(), capacity=128).collect()
    bins, tokens = check(rows, out, 128)
    assert bins <= -(-tokens // 128) + 1
    assert pack(make_docs(rows).limit(0), vocabulary_path()).count() == 0
