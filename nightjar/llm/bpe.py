"""Byte-level BPE by backtracking (operator 10's core).

``Vocabulary`` reads a public tokenizer file and derives three tables from its
merge list: the two parts and merge rank of every token, the pair table, and
an Aho-Corasick automaton over all token byte strings.  ``OffsetTable`` holds
the token bytes in one buffer with an offset table, for decoding.

A token sequence is the merge result exactly when every neighbouring pair is
*compatible*: merging the concatenated bytes of the two would leave the
boundary alone.  The encoder takes the longest token at each position, steps
to shorter prefixes where the pair table objects and backtracks where no
prefix fits; positions that failed once are never entered again, so the work
is linear in the word's length.  Words (pre-tokens) are memoised per worker.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np

# White_Space of Unicode; fixed value.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Words kept per worker before the memo is started anew (memory bound only).
MEMO_WORDS = 250_000
#: Checked pairs kept per worker, likewise.
MEMO_PAIRS = 100_000
#: Longer words are encoded afresh each time instead of being kept.
MEMO_WORD_CHARS = 64
#: A long text is cut into stretches of about this many characters.
STRETCH = 1 << 17


def _ranges(initial: str, top: int) -> str:
    """Character class body, up to code point top, of the general categories
    that begin with a letter."""
    out, start = [], None
    for code in range(top + 2):
        member = code <= top and unicodedata.category(chr(code))[0] == initial
        if member and start is None:
            start = code
        elif not member and start is not None:
            out.append(re.escape(chr(start)) + ("" if start == code - 1 else "-" + re.escape(chr(code - 1))))
            start = None
    return "".join(out)


def pretoken_pattern(top: int = sys.maxunicode) -> re.Pattern:
    """The byte-level pre-token rule for texts without code points over top.
    (Classes that end in the basic plane compile to a bitmap and match about
    four times as fast.)  Letters come first; no other branch starts alike."""
    letter, number = _ranges("L", top), _ranges("N", top)
    return re.compile(
        f" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+"
        f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + i)] = b
    return out


def read_vocabulary(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def token_bytes(spec: dict) -> tuple[list[bytes], dict[str, int]]:
    """(bytes of every id, ids of the special tokens) of a tokenizer file."""
    char = _byte_chars()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["special"]}
    vocabulary = spec["model"]["vocab"]
    text = [b""] * (max([*vocabulary.values(), *special.values()]) + 1)
    for token, i in vocabulary.items():
        text[i] = bytes(char[c] for c in token)
    for token, i in special.items():
        text[i] = token.encode()
    return text, special


class Vocabulary:
    def __init__(self, path: str):
        spec = read_vocabulary(path)
        char = _byte_chars()
        text, self.special = token_bytes(spec)
        size, special = len(text), set(self.special.values())
        ids = {t: i for i, t in enumerate(text) if t and i not in special}
        self.text, self.ids = text, ids
        self.length = [len(t) for t in text]
        # merge tables: rank at which a token is made (-1: a single byte), its
        # two parts, and the rank of each mergeable pair
        self.made, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pair: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b = bytes(char[c] for c in a), bytes(char[c] for c in b)
            x, y, whole = ids[a], ids[b], ids[a + b]
            self.pair[x, y] = rank
            if self.made[whole] < 0:
                self.made[whole], self.left[whole], self.right[whole] = rank, x, y
        self.automaton = ahocorasick.Automaton()
        for tok, i in ids.items():
            self.automaton.add_word(tok.decode("latin-1"), i)
        self.automaton.make_automaton()
        self._shorter: dict[int, int] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        got = self._shorter.get(token)
        if got is None:
            t = self.text[token]
            got = next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1)
            self._shorter[token] = got
        return got

    def fits(self, a: int, b: int) -> bool:
        """Pair compatibility: no merge crosses the boundary of a then b.

        The last merges on either side of the boundary are undone in reverse
        order; a pair meeting at the boundary must not have a rank that would
        have come before the merge just undone (on equal rank the left
        occurrence merges first)."""
        got = self._fits.get((a, b))
        if got is None:
            if len(self._fits) > MEMO_PAIRS:
                self._fits.clear()
            got = self._fits[a, b] = self._check(a, b)
        return got

    def _check(self, a: int, b: int) -> bool:
        x, y, before = a, b, len(self.pair) + 1
        while True:
            rank = self.pair.get((x, y))
            if rank is not None and rank < before:
                return False
            if self.made[x] > self.made[y]:
                before, x = self.made[x], self.right[x]
            elif self.made[y] >= 0:
                before, y = self.made[y] + 1, self.left[y]
            else:
                return True

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        longest = [-1] * n
        size = self.length
        for end, token in self.automaton.iter(word.decode("latin-1")):
            start = end + 1 - size[token]
            if longest[start] < 0 or size[longest[start]] < size[token]:
                longest[start] = token
        out: list[int] = []
        failed = bytearray(n + 1)
        pos, token = 0, longest[0] if n else -1
        while token >= 0:
            end = pos + size[token]
            if not failed[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                pos = end
                token = longest[pos] if pos < n else -1
                continue
            token = self.shorter(token)
            if token < 0:
                failed[pos] = 1
                token = out.pop()
                pos -= size[token]
        return out


class OffsetTable:
    """Decoding: all tokens' bytes in one buffer, and where each begins."""

    def __init__(self, path: str):
        text, _ = token_bytes(read_vocabulary(path))
        self.offsets = np.zeros(len(text) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in text], out=self.offsets[1:])
        self.buffer = np.frombuffer(b"".join(text), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        """Bytes of the ids, gathered from the buffer by the offset table."""
        for i in range(0, len(ids), 1 << 15):
            part = ids[i:i + (1 << 15)]
            start = self.offsets[part]
            count = self.offsets[part + 1] - start
            at = np.repeat(start - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            yield self.buffer[at].tobytes()


class Encoder:
    """Texts to ids through a memo of words, each kept as its packed ids."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.basic, self.full = pretoken_pattern(0xFFFF), pretoken_pattern()
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        memo = self.memo = _Memo()
        memo.vocabulary = self.vocabulary

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        vocabulary, memo, out = self.vocabulary, self.memo, []
        for part in self.special.split(text or "") if self.special else [text or ""]:
            if part in vocabulary.special:
                out.append(np.array([vocabulary.special[part]], dtype="<u4").tobytes())
                continue
            for piece in _stretches(part):
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                pattern = self.full if _ASTRAL.search(piece) else self.basic
                out.append(b"".join([memo[w] for w in pattern.findall(piece)]))
        return b"".join(out)


class _Memo(dict):
    vocabulary: Vocabulary

    def __missing__(self, word: str) -> bytes:
        ids = self.vocabulary.encode_word(word.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= MEMO_WORD_CHARS:
            self[word] = packed
        return packed


_CUT = re.compile(f"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")


def _stretches(text: str) -> Iterator[str]:
    """Cut at a single space between two words: pre-tokens never cross it."""
    at = 0
    while len(text) - at > STRETCH:
        cut = _CUT.search(text, at + STRETCH)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:] if at else text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per vocabulary file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_TABLES: dict[str, OffsetTable] = {}


def offset_table(path: str) -> OffsetTable:
    """One decoding table per vocabulary file and Python worker."""
    if path not in _TABLES:
        _TABLES[path] = OffsetTable(path)
    return _TABLES[path]
