"""Operator 2: n-gram Jaccard join by size-banded tiles of bitmap signatures.

Documents are sets of word shingles; two link when
``den * |x and y| >= num * |x or y|``.  Links of all documents are found (none
is lost, whatever the group sizes), and the result is each document's
component.  Equal sets are one class throughout.

1. *Profile*: per document the set's size, a digest (its class) and a hashed
   parity bitmap, one or two bits per shingle.  Shingles common within slices
   are counted along the way.
2. *Candidates*: similar sets share one of their first ``n - ceil(t n) + 1``
   shingles in any fixed order.  The order puts the most common shingles last
   (a bounded table; it changes the cost, not the result).
3. *Tiles*: documents that share a prefix shingle meet by size band, two
   neighbouring bands to a tile.  Differing bits of two parity bitmaps are
   differing shingles, so their count bounds the overlap from above; pairs
   that cannot reach the threshold go.  A tile reports a spanning tree of
   the pairs left, not the pairs.  Groups of many documents are split into
   tiles of pairs of chunks, after those that one pivot connects are set aside.
4. *Exact check*: sets of the documents that are left, grouped by candidate
   component, in chunks; sorted-array intersections decide; again spanning
   trees only.  A component of several chunks is finished by comparing the
   documents that its pivot did not reach with every chunk.

Cases: null or empty text has an empty set and links with nothing; fewer words
than a shingle make one shingle of the whole sequence; null ids join
components but never name one (a component of null ids only has a null id);
rows that repeat an id are separate documents; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar.llm.common import emit, id_text, materialise, slices
from nightjar.llm.components import components
from nightjar.llm.wordhash import Grams, Words, mix

#: Entries of the table of common shingles (8 bytes each): its size bound.
COMMON = 1 << 16
#: Documents of one side of a tile.
TILE = 1024
#: Documents per chunk of the exact check.
CHUNK = 512
#: Documents that share a shingle before pivots are tried.
HOT = 64


class Join:
    """A similarity threshold num/den on sets of ``words``-word shingles."""

    def __init__(self, words: int, num: int, den: int):
        self.words, self.num, self.den = words, num, den

    def prefix(self, n: int) -> int:
        return n + self.num * n // -self.den + 1

    def linked(self, overlap, x, y):
        return self.den * overlap >= self.num * (x + y - overlap)

    def differ(self, total):
        """Most shingles by which two sets of ``total`` shingles in sum may
        differ: |x xor y| <= total * (den - num) / (den + num)."""
        return total * (self.den - self.num) // (self.den + self.num)

    def band(self, n: Column) -> Column:
        """Bands in which the larger of two linked sizes is at most one up."""
        return F.floor(F.log(n.cast("double")) / float(np.log(self.den / self.num)) + 1e-9).cast("int")

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text of a slice."""
        w = Words(texts, lower=True)
        grams, count, k = Grams(w.hash), w.count(), self.words
        inside = np.zeros(len(w) + 1, dtype=np.int32)
        first = w.first[:-1]
        np.add.at(inside, first[count > 0], 1)
        np.add.at(inside, first[count > 0] + np.maximum(count[count > 0] - k + 1, 1), -1)
        start = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        doc = np.searchsorted(w.first, start, side="right") - 1
        h = grams.of(start, np.minimum(k, count[doc]))
        by = np.lexsort([h, doc])
        doc, h = doc[by], h[by]
        keep = np.ones(len(h), dtype=bool)
        keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        return np.split(h[keep], np.searchsorted(doc[keep], np.arange(1, len(count))))


def _digest(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a sorted set."""
    at = np.arange(len(s), dtype=np.uint64)
    a = mix(s ^ mix(at)).sum(dtype=np.uint64)
    b = mix(s + mix(at ^ np.uint64(0xA5A5A5A5))).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _bitmap(s: np.ndarray) -> bytes:
    """Parity of the shingles per bit; one or two bits a shingle, 128 to 4096
    in all.  (Sets that share little differ in nearly half of the bits, twice
    as many as linked sets may differ in.)"""
    width = min(4096, max(128, 1 << max(len(s) - 1, 0).bit_length()))
    bits = np.bincount((mix(s) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _fold(maps: list[bytes]) -> np.ndarray:
    """Bitmaps of several widths as rows of the least width: the parity of a
    narrower map is the parity of the wider one's stretches."""
    width = min(len(m) for m in maps)
    out = np.empty((len(maps), width // 8), dtype=np.uint64)
    for i, m in enumerate(maps):
        a = np.frombuffer(m, dtype=np.uint64).reshape(-1, width // 8)
        out[i] = np.bitwise_xor.reduce(a, axis=0)
    return out


def profile(docs: DataFrame, join: Join) -> DataFrame:
    """kind 0: (doc, th, n, d1, d2, bitmap) of a document, th its text's hash; kind 1: (d1 = shingle,
    n = documents) of a shingle that three documents of a slice have."""
    types = {"kind": pa.int32(), "doc": pa.int64(), "th": pa.int64(), "n": pa.int64(), "d1": pa.int64(),
             "d2": pa.int64(), "bitmap": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = join.sets(part.column("text"))
                digests = [_digest(s) for s in sets]
                yield emit({"kind": np.zeros(len(sets), np.int32), "doc": part.column("doc_id"),
                            "th": part.column("th"), "n": [len(s) for s in sets], "d1": [d[0] for d in digests],
                            "d2": [d[1] for d in digests], "bitmap": [_bitmap(s) for s in sets]}, types)
                shingle, count = np.unique(np.concatenate(sets), return_counts=True) if sets else ([], [])
                often = np.flatnonzero(np.asarray(count) >= 3)
                if len(often):
                    yield emit({"kind": np.ones(len(often), np.int32), "doc": pa.nulls(len(often), pa.int64()),
                                "th": pa.nulls(len(often), pa.int64()), "n": count[often], "d1": shingle[often].view(np.int64),
                                "d2": pa.nulls(len(often), pa.int64()),
                                "bitmap": pa.nulls(len(often), pa.binary())}, types)

    return docs.mapInArrow(run, "kind int, doc long, th long, n long, d1 long, d2 long, bitmap binary")


def prefixes(docs: DataFrame, join: Join, common: np.ndarray) -> DataFrame:
    """(shingle, d1, n): the prefix of every set, once per class and slice."""
    types = {"shingle": pa.int64(), "d1": pa.int64(), "n": pa.int64()}
    held = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = held.value
        for batch in batches:
            for part in slices(batch):
                out, seen = [], set()
                for s in join.sets(part.column("text")):
                    d1, d2 = _digest(s)
                    if not len(s) or (d1, d2) in seen:
                        continue
                    seen.add((d1, d2))
                    if len(common):
                        late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
                        s = np.concatenate([s[~late], s[late]])
                    p = join.prefix(len(s))
                    out.append((s[:p].view(np.int64), np.full(p, d1), np.full(p, len(late) if len(common) else len(s))))
                if out:
                    yield emit(dict(zip(types, map(np.concatenate, zip(*out, strict=True)), strict=True)), types)

    return docs.mapInArrow(run, "shingle long, d1 long, n long")


def _spanning(n: int, compare) -> list[tuple[int, int]]:
    """A spanning forest of the graph on 0..n-1 whose edges ``compare(i,
    others)`` tells; each node is compared only with nodes not reached yet."""
    left, out = np.arange(n), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = compare(i, left)
            found = left[hit]
            out += [(i, j) for j in found]
            queue += list(found)
            left = left[~hit]
    return out


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows sorted by ``keys``; as many groups at once as a
    batch completes.  Groups are bounded by their tile's size."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t])
        last = np.ones(rest.num_rows, dtype=bool)
        for k in keys:
            col = rest.column(k).to_numpy()
            last &= col == col[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield rest.slice(0, cut).combine_chunks()
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.ones(t.num_rows, dtype=bool)
    new[1:] = np.any([(c := t.column(k).to_numpy())[1:] != c[:-1] for k in keys], axis=0)
    return np.r_[np.flatnonzero(new), t.num_rows]


_EDGE = {"u": pa.int64(), "v": pa.int64()}


def _close(join: Join, maps: np.ndarray, n: np.ndarray, i, others) -> np.ndarray:
    """Whether the bitmaps and sizes leave a pair the chance to link."""
    total = n[others] + n[i]
    fits = join.den * np.minimum(n[others], n[i]) >= join.num * np.maximum(n[others], n[i])
    return fits & (np.bitwise_count(maps[others] ^ maps[i]).sum(axis=1, dtype=np.int64) <= join.differ(total))


def _tile_edges(rows: DataFrame, join: Join) -> DataFrame:
    """Spanning edges of the pairs that may link in each tile of (shingle,
    tile, i, j, d1, n, upper, side, bitmap) rows."""
    keys = ["shingle", "tile", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, keys):
            d1, n = t.column("d1").to_numpy(), t.column("n").to_numpy()
            upper, side = t.column("upper").to_numpy(), t.column("side").to_numpy()
            split = (t.column("i").to_numpy() != t.column("j").to_numpy())
            bounds = _starts(t, keys)
            u, v = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a < 2 or upper[a:b].all():
                    continue
                maps = _fold(t.column("bitmap").slice(a, b - a).to_pylist())
                size, up, at, far = n[a:b], upper[a:b], side[a:b], bool(split[a])

                def compare(i, others, maps=maps, size=size, up=up, at=at, far=far):
                    ok = _close(join, maps, size, i, others)
                    if up[i]:
                        ok &= ~up[others]
                    return ok & (at[others] != at[i]) if far else ok

                for x, y in _spanning(b - a, compare):
                    u.append(d1[a + x])
                    v.append(d1[a + y])
            if u:
                yield emit({"u": np.array(u), "v": np.array(v)}, _EDGE)

    return (rows.repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(run, "u long, v long").where("u != v").distinct())


def _pivot_edges(hot: DataFrame, join: Join) -> DataFrame:
    """Edges of hot rows to the least class of their shingle and band, where
    the two may link."""
    pivot = materialise(hot.groupBy("shingle", "band").agg(F.min(F.struct("d1", "n", "bitmap")).alias("p")), "pivots",
                        narrow=True)
    pairs = (hot.join(pivot, ["shingle", "band"]).where("d1 != p.d1")
             .select("d1", "n", "bitmap", F.col("p.d1").alias("e1"), F.col("p.n").alias("m"),
                     F.col("p.bitmap").alias("bitmap2")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            ok = join.den * np.minimum(n, m) >= join.num * np.maximum(n, m)
            at = np.flatnonzero(ok)
            a, b = batch.column("bitmap").take(pa.array(at)), batch.column("bitmap2").take(pa.array(at))
            bits = np.array([int(np.bitwise_count(f[0] ^ f[1]).sum()) for x, y in
                             zip(a.to_pylist(), b.to_pylist(), strict=True) for f in [_fold([x, y])]], dtype=np.int64)
            at = at[bits <= join.differ((n + m)[at])]
            u, v = batch.column("d1").to_numpy()[at], batch.column("e1").to_numpy()[at]
            code = np.unique(np.stack([u, v], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            yield emit({"u": np.ascontiguousarray(code[:, 0]), "v": np.ascontiguousarray(code[:, 1])}, _EDGE)

    return pairs.mapInArrow(run, "u long, v long").distinct()


def candidates(classes: DataFrame, found: DataFrame, join: Join) -> DataFrame:
    """(node, root) of the classes' candidate components.

    classes: (d1, bitmap); found: prefix rows (shingle, d1, n, holders)."""
    found = materialise(found.withColumn("band", join.band(F.col("n"))), "prefix-rows")
    rows = found.join(classes, "d1")
    hot, cold = rows.where(f"holders > {HOT}"), rows.where(f"holders <= {HOT}")
    edges = materialise(_pivot_edges(hot, join), "pivot-edges", narrow=True)
    reached = components(edges)
    hot = hot.join(reached, hot["d1"] == reached["node"], "left").withColumn("part", F.coalesce("root", "d1"))
    open_ = materialise(hot.groupBy("shingle").agg(F.min("part").alias("a"), F.max("part").alias("b"),
                                                   F.count("*").alias("holders"))
                        .where("a != b").select("shingle", "holders"), "open-groups", narrow=True)
    hot = hot.drop("holders").join(open_, "shingle")
    columns = ["shingle", "band", "d1", "n", "bitmap", "holders"]
    tiles = cold.select(columns).unionByName(hot.select(columns))
    # each document is the smaller side of its band's tile, the larger one of
    # the tile below; many holders are dealt to pairs of chunks
    parts = F.ceil(F.col("holders") / TILE).cast("int")
    tiles = (tiles.withColumn("upper", F.explode(F.array(F.lit(False), F.lit(True))))
             .withColumn("tile", F.col("band") - F.col("upper").cast("int"))
             .withColumn("parts", parts).withColumn("chunk", F.pmod(F.xxhash64("d1"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("shingle", "tile", F.least("chunk", "other").cast("int").alias("i"),
                     F.greatest("chunk", "other").cast("int").alias("j"), "d1", "n", "upper",
                     (F.col("chunk") > F.col("other")).alias("side"), "bitmap"))
    return components(edges.unionByName(_tile_edges(tiles, join)))


def _exact_edges(rows: DataFrame, join: Join, keys: list[str]) -> DataFrame:
    """Spanning edges of the links in each group of (d1, n, items, core):
    core rows are known to be connected and are not compared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, keys):
            d1, n, core = (t.column(c).to_numpy() for c in ("d1", "n", "core"))
            items = t.column("items")
            bounds = _starts(t, keys)
            u, v = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a < 2 or core[a:b].all():
                    continue
                sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in items.slice(a, b - a)]
                size, middle = n[a:b], core[a:b]

                def compare(i, others, sets=sets, size=size, middle=middle):
                    ok = join.den * np.minimum(size[others], size[i]) >= join.num * np.maximum(size[others], size[i])
                    if middle[i]:
                        ok &= ~middle[others]
                    for k in np.flatnonzero(ok):
                        x, y = sets[i], sets[others[k]]
                        short, long = (x, y) if len(x) <= len(y) else (y, x)
                        at = np.minimum(np.searchsorted(long, short), len(long) - 1)
                        ok[k] = join.linked(int((long[at] == short).sum()), len(x), len(y))
                    return ok

                for x, y in _spanning(b - a, compare):
                    u.append(d1[a + x])
                    v.append(d1[a + y])
            if u:
                yield emit({"u": np.array(u), "v": np.array(v)}, _EDGE)

    return (rows.repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(run, "u long, v long").where("u != v").distinct())


def verified(docs: DataFrame, members: DataFrame, join: Join) -> DataFrame:
    """(node, root) of the components of true links.

    docs: (doc_id, text, th); members: (member, mth, d1, root) naming one document
    of each class of a candidate component by its id and its text's hash, so
    that rows that repeat an id meet no classes but their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"root": pa.int64(), "d1": pa.int64(), "n": pa.int64(), "items": pa.binary()}
        before = None
        for batch in batches:
            # rows that repeat an id and its text come one after another: the
            # first stands for all
            d1 = batch.column("d1").to_pylist()
            fresh = [d != (d1[i - 1] if i else before) for i, d in enumerate(d1)]
            before = d1[-1] if d1 else before
            for part in slices(batch.filter(pa.array(fresh, pa.bool_()))):
                sets = join.sets(part.column("text"))
                # of different texts with one id and hash: the one whose set is the class's
                mine = [i for i, (s, d) in enumerate(zip(sets, part.column("d1").to_pylist(), strict=True))
                        if _digest(s)[0] == d]
                at = pa.array(mine, pa.int64())
                yield emit({"root": part.column("root").take(at), "d1": part.column("d1").take(at),
                            "n": [len(sets[i]) for i in mine], "items": [sets[i].tobytes() for i in mine]}, types)

    # the members grow with the corpus: never broadcast
    joined = (docs.join(members.hint("merge"), docs["doc_id"].eqNullSafe(members["member"])
                        & (docs["th"] == members["mth"])).select("text", "d1", "root"))
    sets = materialise(joined.mapInArrow(run, "root long, d1 long, n long, items binary"), "sets")
    count = materialise(sets.groupBy("root").agg(F.count("*").alias("m"), F.min("d1").alias("pivot")), "set-counts",
                        narrow=True)
    sized = sets.join(count, "root").withColumn("chunks", F.ceil(F.col("m") / CHUNK).cast("int"))
    # one chunk each; the component's pivot is a guest in all of them
    home = F.pmod(F.xxhash64("d1"), F.col("chunks")).cast("int")
    placed = sized.withColumn("chunk", F.explode(F.when(
        F.col("d1") == F.col("pivot"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(home))))
    placed = placed.select("root", "chunk", "d1", "n", "items", F.lit(False).alias("core"))
    edges = materialise(_exact_edges(placed, join, ["root", "chunk"]), "links", narrow=True)
    known = components(edges)
    many = sized.where("chunks > 1")
    if many.isEmpty():
        return known
    # components of several chunks: what the pivot's part has not reached
    # meets every chunk
    part = materialise(
        many.select("root", "d1", "n", "items", "chunks", "pivot")
        .join(known.select(F.col("node").alias("d1"), F.col("root").alias("part")), "d1", "left")
        .withColumn("part", F.coalesce("part", "d1")), "parts")
    core = part.where("d1 = pivot").select("root", F.col("part").alias("main"))
    part = part.join(core, "root").withColumn("core", F.col("part") == F.col("main"))
    loose = materialise(part.where("not core").groupBy("root").agg(F.count("*").alias("loose")), "loose",
                        narrow=True)
    part = (part.join(loose, "root").withColumn("groups", F.ceil(F.col("loose") / CHUNK).cast("int"))
            .withColumn("home", F.pmod(F.xxhash64("d1"), F.col("chunks")).cast("int"))
            .withColumn("group", F.pmod(F.hash("d1"), F.col("groups")).cast("int")))
    # every row stands in its chunk against each group of loose rows, and a
    # loose row in its group against each chunk
    stands = F.transform(F.sequence(F.lit(0), F.col("groups") - 1),
                         lambda g: F.struct(F.col("home").alias("chunk"), g.alias("group")))
    visits = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1),
                         lambda c: F.struct(c.alias("chunk"), F.col("group").alias("group")))
    met = (part.withColumn("at", F.explode(F.when(F.col("core"), stands)
                                           .otherwise(F.array_distinct(F.concat(stands, visits)))))
           .select("root", F.col("at.chunk").alias("chunk"), F.col("at.group").alias("group"), "d1", "n", "items",
                   "core"))
    return components(edges.unionByName(_exact_edges(met, join, ["root", "chunk", "group"])))


def near_duplicates(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    join = Join(words, num, den)
    docs = id_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    seen = materialise(profile(docs, join), "profile")
    every = seen.where("kind = 0").select("doc", "n", "d1", "d2")
    common = (seen.where("kind = 1").groupBy("d1").agg(F.sum("n").alias("n"))
              .orderBy(F.desc("n"), "d1").limit(COMMON).select("d1"))
    table = np.sort(np.array([r[0] for r in common.collect()], dtype=np.int64).view(np.uint64))

    rows = materialise(prefixes(docs, join, table), "prefixes")
    # shingles of one holder, or of two whose sizes cannot link, lead nowhere
    shared = (rows.groupBy("shingle")
              .agg(F.count("*").alias("holders"), F.min("n").alias("least"), F.max("n").alias("most"))
              .where(f"holders > 2 or holders = 2 and {den} * least >= {num} * most").select("shingle", "holders"))
    shared = materialise(shared, "shared")
    found = rows.join(shared, "shingle").groupBy("shingle", "d1").agg(
        F.max("n").alias("n"), F.max("holders").alias("holders"))
    # one document and bitmap of each class
    classes = (seen.where("kind = 0 and n > 0").groupBy("d1")
               .agg(F.min_by("bitmap", "th").alias("bitmap"), F.min(F.struct("doc", "th")).alias("m"))
               .select("d1", F.col("m.doc").alias("member"), F.col("m.th").alias("mth"), "bitmap"))
    classes = materialise(classes, "classes")
    near = candidates(classes.select("d1", "bitmap"), found, join)
    members = classes.join(near, classes["d1"] == near["node"]).select("member", "mth", "d1", "root")
    links = materialise(verified(docs, materialise(members, "members", narrow=True), join), "components", narrow=True)

    keyed = (every.join(links, every["d1"] == links["node"], "left")
             .withColumn("k1", F.coalesce("root", "d1"))
             .withColumn("k2", F.when(F.col("root").isNull(), F.col("d2")).otherwise(F.lit(0))))
    keyed = keyed.withColumn("k2", F.when(F.col("n") > 0, F.col("k2")))
    least = materialise(keyed.where("n > 0").groupBy("k1", "k2").agg(F.min("doc").alias("component_id")), "least",
                        narrow=True)
    linked = keyed.where("n > 0").join(least, ["k1", "k2"]).select("doc", "n", "component_id")
    alone = every.where("n = 0").select("doc", "n", F.col("doc").alias("component_id"))
    return linked.unionByName(alone).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
                                            "component_id")
