"""Operator 12: prefix trie of conversations.

A conversation is the sequence of its turns' 128-bit keys.  Equal sequences
are folded, the distinct ones sorted globally, and the trie is read off the
lengths of the longest common prefixes (LCP) of sorted neighbours: within a
block of a sorted partition, union-find merges neighbours in descending LCP;
every merge of two components is a branching node, whose path down to its
children is written out node by node.  A block knows the sequences just
before and after it, so it also knows which nodes reach beyond it: at most the
prefixes of its first and of its last sequence.  Those partition forests are
contracted to these open nodes, whose sums are merged across boundaries by key.

Everything reported of a node is a sum, or a minimum, over its distinct
sequences: members; leaves (sequences that the next one does not extend);
children and words of the subtree's nodes (a node counts at the first sequence
that has it, i.e. whose LCP with the sequence before is shorter).  So a prefix
shared by a third of all conversations costs one row per block.

A sequence is held whole by one row (32 bytes a turn; texts never are).  The
hash over a node's ending conversations is one sequential SHA-256 by
contract: their ids are joined in fixed ranges first and streamed.

Cases: turns go by (turn, then key) with null turns first, and repeated rows
are turns of their own; null role or text counts as empty; rows without a
conv_id belong to no conversation and are left out; an empty table has no
node; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar.llm.common import materialise

#: Characters of a turn's key in a sequence.
KEY = 32
#: Turns that one union-find holds (a longer conversation is a block of its own).
BLOCK_TURNS = 1 << 16
#: Conversation ids whose decimals are joined in one row before a node's hash.
ID_RANGE = 1024

NODE = ("key string, parent string, block long, depth long, open boolean, first long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, parent_first long")


def n_words(text: Column) -> Column:
    """Number of runs of characters that are not ASCII white space."""
    return F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (key, words)."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    keyed = turns.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.struct(F.col(f"`{turn_col}`").cast("long").alias("turn"),
                 F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("key"),
                 n_words(text).alias("words")).alias("t"))
    return keyed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))


def rebuilt(seqs: DataFrame, span: int = 20, heads: int = 4) -> DataFrame:
    """Conversations whose first h = crc32(id) % heads turns are replaced by
    the first h of conversation id - id % span."""
    c = F.col("conv_id")
    first = seqs.select(c.alias("base"), F.slice("turns", 1, heads - 1).alias("lent"))
    asked = seqs.select("conv_id", "turns", (c - c % span).alias("base"),
                        (F.crc32(c.cast("string").cast("binary")) % heads).cast("int").alias("h"))
    joined = asked.join(first, "base", "left")
    none = F.array().cast("array<struct<key:string,words:int>>")
    return joined.select("conv_id", F.concat(
        F.coalesce(F.slice("lent", F.lit(1), F.col("h")), none),
        F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _common(a: str, b: str) -> int:
    """Turns that two sequences share at their beginning."""
    i, n = 0, min(len(a), len(b))
    while i < n and a[i:i + KEY] == b[i:i + KEY]:
        i += KEY
    return i // KEY


class _Tree:
    """A component of sorted neighbours, with its top node not yet written."""

    __slots__ = ("lo", "hi", "depth", "n", "first", "leaves", "spent", "distinct", "children", "below")

    def __init__(self, i: int, depth: int, n: int, first: int, leaves: int, spent: int, distinct: int):
        self.lo = self.hi = i
        self.depth, self.n, self.first, self.leaves = depth, n, first, leaves
        self.spent, self.distinct = spent, distinct  # words of members' turns, and of nodes, from here down
        self.children, self.below = 0, []  # number born here, places of the written ones


class Block:
    """Trie nodes of consecutive sorted sequences (key string, words, members,
    smallest id) between the neighbours ``left`` and ``right``."""

    def __init__(self, number: int, rows: list, left: str | None, right: str | None):
        self.number, self.rows = number, rows
        self.before = -1 if left is None else _common(left, rows[0][0])
        self.after = -1 if right is None else _common(rows[-1][0], right)
        self.lcp = [_common(a[0], b[0]) for a, b in zip(rows, rows[1:])]
        self.nodes: list[list] = []
        self._name()

    def _name(self) -> None:
        """Key of every node that begins at a sequence, from its LCP on."""
        states, self.keys = [hashlib.md5()], []
        for i, (sequence, *_) in enumerate(self.rows):
            known = self.lcp[i - 1] if i else 0
            del states[known + 1:]
            for e in range(known, len(sequence) // KEY):
                state = states[-1].copy()
                state.update(sequence[e * KEY:(e + 1) * KEY].encode())
                states.append(state)
            low = known + 1 if i else 0
            self.keys.append((low, [s.hexdigest() for s in states[low:]]))

    def _born(self, i: int, depth: int) -> bool:
        """Whether no earlier sequence, in this block or before, has the node."""
        return depth > (self.lcp[i - 1] if i else self.before)

    def _raise(self, tree: _Tree, depth: int) -> None:
        """Write the nodes from the top of the tree down to depth + 1 turns;
        the top is then the (unwritten) prefix of ``depth`` turns."""
        words = self.rows[tree.lo][1]
        while tree.depth > depth:
            d, lo, hi = tree.depth, tree.lo, tree.hi
            low, keys = self.keys[lo]
            is_open = (lo == 0 and d <= self.before) or (hi == len(self.rows) - 1 and d <= self.after)
            place = len(self.nodes)
            for b in tree.below:
                self.nodes[b][1] = place
            self.nodes.append([keys[d - low], None, d, is_open, tree.first, tree.n, tree.children, tree.leaves,
                               tree.spent - tree.distinct])
            tree.below, tree.children = [place], int(self._born(lo, d))
            tree.depth = d = d - 1
            if d > 0:
                tree.spent += tree.n * words[d - 1]
                tree.distinct += words[d - 1] if self._born(lo, d) else 0

    def _merge(self, a: _Tree, b: _Tree, depth: int) -> _Tree:
        """Two neighbouring components whose common prefix has ``depth`` turns."""
        self._raise(a, depth)
        self._raise(b, depth)
        a.hi, a.n, a.first, a.leaves = b.hi, a.n + b.n, min(a.first, b.first), a.leaves + b.leaves
        a.spent, a.distinct = a.spent + b.spent, a.distinct + b.distinct
        a.children, a.below = a.children + b.children, a.below + b.below
        return a

    def build(self) -> list[list]:
        parent = list(range(len(self.rows)))
        trees: list[_Tree | None] = []
        for i, (sequence, words, n, first) in enumerate(self.rows):
            depth = len(sequence) // KEY
            follows = self.lcp[i] if i < len(self.lcp) else self.after
            own = words[depth - 1] if depth else 0
            trees.append(_Tree(i, depth, n, first, int(follows < depth), n * own, own if self._born(i, depth) else 0))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i
        for e in sorted(range(len(self.lcp)), key=lambda e: -self.lcp[e]):
            x, y = find(e), find(e + 1)
            trees[x] = self._merge(trees[x], trees[y], self.lcp[e])
            parent[y], trees[y] = x, None
        whole = trees[find(0)]
        # the root is written as a last node of depth 0
        self._raise(whole, -1)
        return self.nodes

    def batch(self) -> pa.RecordBatch:
        out = []
        for key, place, d, is_open, *sums in self.build():
            up = self.nodes[place] if place is not None else None
            out.append((key, up and up[0], self.number, d, is_open, *sums, up[4] if up and not up[3] else None))
        return pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)


_NAMES = [x.split()[0] for x in NODE.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in NODE.split(", ")]


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Block]:
    """Blocks of rows sorted by (part, seq); ``ghost`` rows are the sequences
    just outside of a part."""
    part, left, rows, turns, number = None, None, [], 0, 0
    for batch in batches:
        for p, seq, words, n, first, ghost in zip(*(batch.column(c).to_pylist() for c in (
                "part", "seq", "words", "n", "first", "ghost"))):
            if rows and (p != part or ghost or turns > limit):
                yield Block((part << 32) + number, rows, left, seq if p == part else None)
                left, rows, turns, number = rows[-1][0], [], 0, number + 1
            if p != part:
                part, left, number = p, None, 0
            if ghost:
                left = seq
                continue
            rows.append((seq, words, n, first))
            turns += 1 + len(words)
    if rows:
        yield Block((part << 32) + number, rows, left, None)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches, BLOCK_TURNS):
        yield block.batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's id texts, streamed in order."""
    key, state = None, None
    for batch in batches:
        keys, out = [], []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k != key:
                if key is not None:
                    keys.append(key)
                    out.append(state.hexdigest())
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.record_batch([pa.array(keys, pa.string()), pa.array(out, pa.string())], names=["key", "ends_sha256"])
    if key is not None:
        yield pa.record_batch([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def ends(members: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the sequences' member ids, ascending."""
    ranged = members.groupBy("key", F.floor(F.col("conv_id") / ID_RANGE).alias("at")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return ranged.repartition("key").sortWithinPartitions("key", "at").select("key", "ids").mapInArrow(
        _digests, "key string, ends_sha256 string")


def trie(seqs: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of (conv_id, turns) rows."""
    spelled = materialise(seqs.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["key"]), "").alias("seq"),
        F.transform("turns", lambda t: t["words"]).alias("words")).withColumn("key", F.md5("seq")), "sequences")
    distinct = spelled.groupBy("key").agg(F.first("seq").alias("seq"), F.first("words").alias("words"),
                                          F.count("*").alias("n"), F.min("conv_id").alias("first")).drop("key")
    ordered = materialise(distinct.repartitionByRange("seq").sortWithinPartitions("seq")
                          .withColumn("part", F.spark_partition_id()), "sorted-sequences")
    nodes = materialise(_with_neighbours(ordered).mapInArrow(_forests, NODE), "nodes")

    opened = nodes.where("open")
    merged = materialise(opened.groupBy("key").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("first").alias("first"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]), "open-nodes", narrow=True)
    # what a block's open nodes became, for their children in the block
    known = opened.select("block", F.col("key").alias("parent")).join(
        merged.select(F.col("key").alias("parent"), F.col("first").alias("parent_conv_id")), "parent")
    facts = ["key", "first", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    closed = nodes.where("not open")
    inside = closed.where("parent_first is not null or parent is null").withColumn("parent_conv_id", F.col("parent_first"))
    edge = closed.where("parent_first is null and parent is not null").join(known, ["block", "parent"])
    across = merged.join(merged.select(F.col("key").alias("parent"), F.col("first").alias("parent_conv_id")),
                         "parent", "left")
    every = inside.select(facts).unionByName(edge.select(facts)).unionByName(across.select(facts))
    nothing = hashlib.sha256(b"").hexdigest()
    return every.join(ends(spelled.select("key", "conv_id")), "key", "left").select(
        F.col("first").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def _with_neighbours(ordered: DataFrame) -> DataFrame:
    """The sorted parts, each with the sequences just before and after it."""
    bounds = materialise(ordered.select("part", "seq").groupBy("part").agg(
        F.min("seq").alias("head"), F.max("seq").alias("tail")), "bounds", narrow=True)
    # one row per part of the sorted table
    order = "over (order by part)"
    ring = bounds.selectExpr("part", f"lag(tail) {order} as before", f"lead(head) {order} as after")
    ghosts = ring.selectExpr("part", "explode(array(before, after)) as seq").where("seq is not null")
    rows = ordered.withColumn("ghost", F.lit(False)).unionByName(
        ghosts.withColumn("ghost", F.lit(True)), allowMissingColumns=True)
    return rows.repartition("part").sortWithinPartitions("part", "seq")


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The query's nodes: the trie of the rebuilt conversations."""
    return trie(rebuilt(sequences(turns)))
