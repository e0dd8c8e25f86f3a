"""Operator 1: substring dedup by relative Lempel-Ziv parsing.

The corpus is its own reference.  Documents are factored against it; a word
is removed when a window of ``window`` consecutive words that covers it starts
earlier somewhere (a smaller id, or earlier in the same document).

1. *Index.*  Of every window the ``GRAM``-word phrase with the least hash is
   its anchor, so equal windows have equal anchors at equal places and a
   document has about one anchor in eight words.  A reference block runs from
   an anchor through the next one.  The index holds, for every anchor phrase,
   its first place in the corpus and that place's block hash.
2. *Parse.*  Each document gets the index entries of its anchors.  Greedily,
   a factor is a run of blocks equal to reference blocks that follow one
   another in one reference document; factors of ``window`` words or more are
   duplicate spans.
3. *Factor boundaries.*  Windows whose anchor is known elsewhere but which lie
   in no factor are looked up one by one: their 96-bit hashes meet in a second
   shuffle, where all but the smallest id lose.  (The first place of a window
   is never inside a factor, since a factor has an earlier source; so the
   windows that meet are enough to tell which is first.)

Both lookups go through ``first_seen``: no key gathers more rows in a task
than there are slices of the corpus.  No step holds more than a batch.

Cases: null or empty text has no words; ids may be null (such rows come after
all others); rows that repeat an id count as one document in two copies,
neither of which precedes the other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.llm.common import emit, fresh, slices
from nightjar.llm.first_seen import NULL_ID, GroupStream, leaders
from nightjar.llm.wordhash import Grams, Words, mix

#: Words of an anchor phrase.
GRAM = 6


class Parsed:
    """Words and anchors of a slice of documents."""

    def __init__(self, texts: pa.Array, window: int):
        w = self.words = Words(texts)
        self.window, n = window, len(w)
        self.grams = Grams(w.hash)
        gram = min(GRAM, window)
        # starts of windows that stay inside their document
        inside = np.zeros(n + 1, dtype=np.int32)
        long = w.count() >= window
        np.add.at(inside, w.first[:-1][long], 1)
        np.add.at(inside, w.first[1:][long] - window + 1, -1)
        self.starts = np.flatnonzero(np.cumsum(inside[:n]) > 0)
        if not len(self.starts):
            self.anchor_of = self.at = self.doc = self.key = self.block = np.zeros(0, np.int64)
            self.length = self.at
            return
        phrase = self.grams.of(np.arange(n - gram + 1), gram)
        least = sliding_window_view(phrase, window - gram + 1)
        chosen = least[self.starts].argmin(axis=1) + self.starts
        self.at, self.anchor_of = np.unique(chosen, return_inverse=True)
        self.doc = np.searchsorted(w.first, self.at, side="right") - 1
        self.key = phrase[self.at].view(np.int64)
        # a block ends with the next anchor's phrase, the last with the document
        stop = w.first[1:][self.doc].copy()
        same = self.doc[1:] == self.doc[:-1]
        stop[:-1][same] = self.at[1:][same] + gram
        self.length = stop - self.at
        self.block = mix(self.grams.of(self.at, self.length) ^ self.length.astype(np.uint64)).view(np.int64)

    def pos(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return (at - self.words.first[doc]).astype(np.int32)


def _ids(batch: pa.RecordBatch, col: str) -> np.ndarray:
    return batch.column(col).cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


_INDEX = {"key": pa.int64(), "block": pa.int64(), "doc": pa.int64(), "th": pa.int32(), "pos": pa.int32(),
          "tag": pa.int32(), "settled": pa.bool_(), "many": pa.bool_(), "rdoc": pa.int64(), "rpos": pa.int32(),
          "same": pa.bool_()}
_REF = {"doc": pa.int64(), "th": pa.int32(), "pos": pa.int32(), "tag": pa.int32(), "rdoc": pa.int64(), "rpos": pa.int32(),
        "same": pa.bool_()}


def _spread(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A key of its own for a row that is settled already."""
    return mix(mix(doc.astype(np.uint64)) + pos.astype(np.uint64)).view(np.int64)


def references(docs: DataFrame, window: int) -> DataFrame:
    """(doc, th, pos, tag, rdoc, rpos, same): every anchor that occurs in more than one
    document, with the corpus' first place of its phrase (null where this is
    it) and whether the whole block equals that place's block.  ``tag`` is a
    piece of the block's hash: of several rows with one id, an entry is for
    those that have this block at this place.

    docs: (doc long, text)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p = Parsed(part.column("text"), window)
                doc, pos = _ids(part, "doc")[p.doc], p.pos(p.at, p.doc)
                th = part.column("th").to_numpy(zero_copy_only=False)[p.doc]
                # an anchor phrase that a document repeats is the parser's own
                # business; only its first place there is looked up
                lead, _ = leaders([p.doc, p.key], [pos])
                own = np.flatnonzero(lead == np.arange(len(lead)))
                key, block, doc, th, pos = p.key[own], p.block[own], doc[own], th[own], pos[own]
                lead, size = leaders([key], [doc, pos])
                settled = lead != np.arange(len(lead))
                rdoc, rpos = doc[lead], pos[lead]
                yield emit({"key": np.where(settled, _spread(doc, pos), key), "block": block, "doc": doc, "th": th,
                            "pos": pos, "tag": block.astype(np.int32), "settled": settled, "many": size > 1,
                            "rdoc": pa.array(rdoc, mask=~settled), "rpos": pa.array(rpos, mask=~settled),
                            "same": settled & (block == block[lead]) & (rdoc < doc)}, _INDEX)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = GroupStream(["key"])
        for batch in batches:
            done = batch.filter(batch.column("settled"))
            if done.num_rows:
                yield emit({k: done.column(k) for k in _REF}, _REF)
            open_ = batch.filter(pa.compute.invert(batch.column("settled")))
            if not open_.num_rows:
                continue
            begun = groups.front is not None
            c, lead, follower, second = groups.feed(
                {k: open_.column(k).to_numpy(zero_copy_only=False) for k in ("key", "block", "doc", "th", "pos", "many")})
            # the first of a group is reported with its first follower, or at
            # once where it had followers in its own slice
            first = np.unique(np.r_[lead[second], np.flatnonzero(~follower & c["many"])[int(begun and c["many"][0]):]])
            f = np.flatnonzero(follower)
            at, src = np.r_[first, f], np.r_[first, lead[f]]
            head = np.arange(len(at)) < len(first)
            yield emit({"doc": c["doc"][at], "th": c["th"][at], "pos": c["pos"][at], "tag": c["block"][at].astype(np.int32),
                        "rdoc": pa.array(c["doc"][src], mask=head), "rpos": pa.array(c["pos"][src], mask=head),
                        "same": ~head & (c["block"][at] == c["block"][src]) & (c["doc"][src] < c["doc"][at])}, _REF)

    rows = docs.mapInArrow(scan, "key long, block long, doc long, th int, pos int, tag int, settled boolean, many boolean, "
                                 "rdoc long, rpos int, same boolean")
    return (rows.repartition("key").sortWithinPartitions("key", "doc", "pos")
            .mapInArrow(settle, "doc long, th int, pos int, tag int, rdoc long, rpos int, same boolean"))


class Factored(Parsed):
    """The parse of a slice: factors, and for every window start whether it is
    known to occur earlier; the others with a known anchor are ``open``."""

    def __init__(self, texts: pa.Array, window: int, doc_ids: np.ndarray, refs: pa.Array):
        super().__init__(texts, window)
        w, n = self.words, len(self.words)
        self.ids = doc_ids
        self.dup = np.zeros(n, dtype=bool)
        m = len(self.at)
        live, same = np.zeros(m, dtype=bool), np.zeros(m, dtype=bool)
        rdoc, rpos = np.full(m, -1, np.int64), np.full(m, -1, np.int64)
        owner = np.repeat(np.arange(len(refs)), pa.compute.fill_null(pa.compute.list_value_length(refs), 0))
        flat = refs.flatten()
        if len(flat) and m:
            place = w.first[owner] + flat.field("pos").to_numpy()
            i = np.minimum(np.searchsorted(self.at, place), m - 1)
            ok = ((self.at[i] == place) & (self.doc[i] == owner)
                  & (self.block[i].astype(np.int32) == flat.field("tag").to_numpy()))
            i = i[ok]
            live[i], same[i] = True, flat.field("same").to_numpy(zero_copy_only=False)[ok]
            rdoc[i] = flat.field("rdoc").fill_null(-1).to_numpy()[ok]
            rpos[i] = flat.field("rpos").fill_null(-1).to_numpy()[ok]
        # anchors that the document itself has had before
        lead, size = leaders([self.doc, self.key], [self.at])
        live |= live[lead] | (size > 1) if m else live
        own = (lead != np.arange(m)) & ~same & (self.block == self.block[lead]) if m else same
        same |= own
        rdoc[own] = doc_ids[self.doc[own]]
        rpos[own] = self.pos(self.at[lead[own]], self.doc[own])
        # greedy factors: neighbouring equal blocks of one aligned source
        joined = np.zeros(m, dtype=bool)
        if m:
            joined[1:] = (same[1:] & same[:-1] & (self.doc[1:] == self.doc[:-1]) & (rdoc[1:] == rdoc[:-1])
                          & (rpos[1:] - rpos[:-1] == self.at[1:] - self.at[:-1]))
        first = np.flatnonzero(same & ~joined)
        last = np.r_[first[1:], m][:len(first)] - 1
        # a run ends at its last equal block, not at the next run's start
        run_end = np.flatnonzero(same & ~np.r_[joined[1:], False]) if m else first
        last = run_end
        start, stop = self.at[first], self.at[last] + self.length[last]
        enough = stop - start >= window
        self.factor_doc, self.factor_start = self.doc[first][enough], start[enough]
        self.factor_stop = stop[enough]
        self.factor_rdoc, self.factor_rpos = rdoc[first][enough], rpos[first][enough]
        edge = np.zeros(n + 1, dtype=np.int32)
        np.add.at(edge, self.factor_start, 1)
        np.add.at(edge, self.factor_stop - window + 1, -1)
        if n:
            self.dup |= np.cumsum(edge[:n]) > 0
        # boundary windows; one that its document has had before is a duplicate
        check = self.starts[live[self.anchor_of] & ~self.dup[self.starts]] if m else self.starts
        self.hash = self.grams.of(check, window).view(np.int64)
        self.second = Grams(w.hash, second=True)
        self.hash2 = self.second.of(check, window).view(np.int64).astype(np.int32)
        doc = np.searchsorted(w.first, check, side="right") - 1
        lead, _ = leaders([doc, self.hash, self.hash2], [check])
        repeat = lead != np.arange(len(lead))
        self.dup[check[repeat]] = True
        keep = ~repeat
        self.open, self.open_doc = check[keep], doc[keep]
        self.hash, self.hash2 = self.hash[keep], self.hash2[keep]

    def covered(self, later: pa.Array) -> np.ndarray:
        """Words inside any duplicate window, given the boundary windows (place
        and part of the hash) that turned out to occur earlier elsewhere."""
        n = len(self.words)
        dup = self.dup.copy()
        owner = np.repeat(np.arange(len(later)), pa.compute.fill_null(pa.compute.list_value_length(later), 0))
        flat = later.flatten()
        if len(flat):
            place = self.words.first[owner] + flat.field("pos").to_numpy()
            ok = place + self.window <= self.words.first[owner + 1]
            place, tag = place[ok], flat.field("tag").to_numpy()[ok]
            dup[place[self.second.of(place, self.window).view(np.int64).astype(np.int32) == tag]] = True
        edge = np.zeros(n + self.window + 1, dtype=np.int32)
        at = np.flatnonzero(dup)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.window, -1)
        return np.cumsum(edge[:n]) > 0


def _kept_text(p: Parsed, gone: np.ndarray, layout: bool) -> list[str]:
    """Kept words joined by a space, or the text without the removed words and
    the white space after each."""
    w, out = p.words, []
    raw = w.raw.tobytes()
    for i in range(len(w.first) - 1):
        a, b = w.first[i], w.first[i + 1]
        g = gone[a:b]
        if layout:
            lo, hi = w.offsets[i], w.offsets[i + 1]
            if not g.any():
                out.append(raw[lo:hi].decode())
                continue
            nxt = np.r_[w.start[a + 1:b], hi]
            flip = np.flatnonzero(np.diff(np.r_[False, g, False].astype(np.int8)))
            parts, at = [], lo
            for s, e in zip(flip[::2], flip[1::2], strict=True):
                parts.append(raw[at:w.start[a + s]])
                at = nxt[e - 1]
            out.append(b"".join([*parts, raw[at:hi]]).decode())
        else:
            k = np.flatnonzero(~g) + a
            out.append(b" ".join([raw[s:e] for s, e in zip(w.start[k].tolist(), w.end[k].tolist(),
                                                           strict=True)]).decode())
    return out


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text",
                   layout: bool = True) -> DataFrame:
    """Every row of ``docs`` with ``text_col`` cut, plus ``n_words``,
    ``n_removed`` and ``factors`` (array of start, length, ref_doc, ref_start
    in words; the spans that the parse found in whole blocks).

    layout=False joins the kept words by one space instead of keeping the
    text's own white space.  Output names that ``docs`` already has are
    replaced."""
    outs = ["n_words", "n_removed", "factors"]
    docs = docs.drop(*outs)
    names = docs.columns
    doc, th, refs_col, later_col = fresh(docs, "_doc", "_th", "_refs", "_later")
    keyed = docs.withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), th: F.hash(text_col)})
    plain = keyed.select(F.col(doc).alias("doc"), F.col(th).alias("th"), F.col(text_col).alias("text"))
    # sets: rows that repeat an id and its text bring the same entries
    refs = (references(plain, window).groupBy(F.col("doc").alias(doc), F.col("th").alias(th))
            .agg(F.collect_set(F.struct("pos", "tag", "rdoc", "rpos", "same")).alias(refs_col)))
    known = keyed.join(refs, [doc, th], "left")

    opened = {"key": pa.int64(), "key2": pa.int32(), "doc": pa.int64(), "th": pa.int32(), "pos": pa.int32(),
              "settled": pa.bool_()}

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                ids = _ids(part, doc)
                f = Factored(part.column(text_col), window, ids, part.column(refs_col))
                owner, pos = ids[f.open_doc], f.pos(f.open, f.open_doc)
                own_th = part.column(th).to_numpy(zero_copy_only=False)[f.open_doc]
                lead, _ = leaders([f.hash, f.hash2], [owner])
                settled = owner[lead] < owner
                yield emit({"key": np.where(settled, _spread(owner, pos), f.hash), "key2": f.hash2, "doc": owner,
                            "th": own_th, "pos": pos, "settled": settled}, opened)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = GroupStream(["key", "key2"])
        out = {"doc": pa.int64(), "th": pa.int32(), "pos": pa.int32(), "tag": pa.int32()}
        for batch in batches:
            done = batch.filter(batch.column("settled"))
            if done.num_rows:
                yield emit({"doc": done.column("doc"), "th": done.column("th"), "pos": done.column("pos"),
                            "tag": done.column("key2")}, out)
            open_ = batch.filter(pa.compute.invert(batch.column("settled")))
            if open_.num_rows:
                c, lead, follower, _ = groups.feed(
                    {k: open_.column(k).to_numpy(zero_copy_only=False) for k in ("key", "key2", "doc", "th", "pos")})
                late = np.flatnonzero(follower & (c["doc"][lead] < c["doc"]))
                yield emit({"doc": c["doc"][late], "th": c["th"][late], "pos": c["pos"][late], "tag": c["key2"][late]}, out)

    # all columns go in, so that both passes over ``known`` share one shuffle
    later = (known.mapInArrow(boundaries, "key long, key2 int, doc long, th int, pos int, settled boolean")
             .repartition("key").sortWithinPartitions("key", "key2", "doc")
             .mapInArrow(settle, "doc long, th int, pos int, tag int")
             .groupBy(F.col("doc").alias(doc), F.col("th").alias(th))
             .agg(F.collect_set(F.struct("pos", "tag")).alias(later_col)))
    both = known.join(later, [doc, th], "left")

    factor = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc", pa.int64()),
                        ("ref_start", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                p = Factored(part.column(text_col), window, _ids(part, doc), part.column(refs_col))
                gone = p.covered(part.column(later_col))
                total = np.r_[0, np.cumsum(gone)]
                texts = _kept_text(p, gone, layout)
                valid = part.column(text_col).is_valid().to_pylist()
                found = pa.StructArray.from_arrays(
                    [pa.array(p.pos(p.factor_start, p.factor_doc)),
                     pa.array((p.factor_stop - p.factor_start).astype(np.int32)),
                     pa.array(p.factor_rdoc), pa.array(p.factor_rpos.astype(np.int32))], fields=list(factor))
                offsets = np.searchsorted(p.factor_doc, np.arange(part.num_rows + 1)).astype(np.int32)
                cols = [pa.array([t if ok else None for t, ok in zip(texts, valid, strict=True)], pa.string())
                        if c == text_col else part.column(c) for c in names]
                yield pa.record_batch(
                    [*cols, pa.array(p.words.count().astype(np.int64)),
                     pa.array((total[p.words.first[1:]] - total[p.words.first[:-1]]).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(offsets), found)], names=[*names, *outs])

    schema = T.StructType([*(T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType)
                             for f in docs.schema.fields),
                           T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("factors", T.ArrayType(T.StructType([
                               T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()),
                               T.StructField("ref_doc", T.LongType()), T.StructField("ref_start", T.IntegerType())])))])
    return both.mapInArrow(cut, schema)
