import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from nightjar.llm import bpe
from nightjar.llm.queries import vocabulary_path
from nightjar.llm.tokens import decode, encode, token_digests

PARTS = ["a", "the", " ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "'S", "\xe9", "\xdf", "\u4e2d\u6587",
         "\U0001f44d\U0001f3fd", "\u200b", "\xa0", "\x85", "\x1c", "1", "\xbd", "\xb2", "_", "...", "!!!",
         "<|endoftext|>", "<|end", "\u0301", " ", "ing", "tion", "aaaa", "\x00", "\ufb01", "\U0001d518", "\u3000",
         "ab"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def texts(n=2000, seed=4):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_same_ids_and_text_as_the_library(library):
    coder, table = bpe.encoder(vocabulary_path()), bpe.offset_table(vocabulary_path())
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        mine = np.frombuffer(coder.packed(t), dtype="<u4")
        assert mine.tolist() == ids, t
        assert b"".join(table.decode(mine)).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_broken_sequences_decode_as_replacement(library):
    table = bpe.offset_table(vocabulary_path())
    ids = library.encode("é中", add_special_tokens=False).ids
    for k in range(len(ids)):
        got = b"".join(table.decode(np.array(ids[:k]))).decode("utf-8", "replace")
        assert got == library.decode(ids[:k], skip_special_tokens=False)


def test_every_token_of_letters_and_long_words(library):
    coder, rnd = bpe.encoder(vocabulary_path()), random.Random(2)
    for n in (1, 2, 3, 7, 40, 300):
        for _ in range(60):
            w = "".join(rnd.choice("abcdeinrst") for _ in range(n))
            assert np.frombuffer(coder.packed(w), dtype="<u4").tolist() == library.encode(w).ids


def test_memo_bound_and_stretches(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 5)
    monkeypatch.setattr(bpe, "STRETCH", 30)
    coder = bpe.Encoder(vocabulary_path())
    t = "one two  three\nfour five six seven eight\xa0nine ten " * 20
    assert np.frombuffer(coder.packed(t), dtype="<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_columns(make_docs, library):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b"), (4, "long <|endoftext|> text " * 60_000)]
    df = make_docs(rows).selectExpr("*", "'x' as ids", "7 as n_tokens")
    out = decode(encode(df, vocabulary_path()), vocabulary_path()).collect()
    assert len(out) == 6
    for r in out:
        assert list(r.ids) == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "") and r.n_tokens == 7
    d = {r.doc_id: r for r in token_digests(df, vocabulary_path()).collect()}
    ids = library.encode("a b").ids
    assert d[3].n_tokens == len(ids) and d[3].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert d[1].n_tokens == 0 and d[1].ids_sha256 == hashlib.sha256(b"").hexdigest() == d[2].decoded_sha256
    assert encode(df.limit(0), vocabulary_path()).count() == 0
