"""Operator 13: ranked lexical search, term at a time with limited
accumulators.

Documents are tokenised once into postings of the query terms (``postings``,
a written table: one row per document with its length, the query terms it
holds and their frequencies).  Corpus statistics are sums over that table.
Then each task takes its documents block by block and ranks them for every
query of the block of queries: terms are processed rarest first; a document
gets an accumulator when a term reaches it, until the bounds of the terms that
remain, this one included, cannot lift a document without an accumulator to
the k-th best score known (the k-th partial score of the block, or the k-th
best document of the task so far); from then on only the documents that have
accumulators are updated, exactly.  Each task reports its k best per query and
the k best of those are the answer: every document that could be among them
had an accumulator, so no score is approximate.

Queries are taken in blocks bounded by their number of terms; only a block's
terms and their weights are on the driver and in the tasks, never the corpus.

Terms are the maximal runs of ASCII letters and digits and of all characters
beyond ASCII, with A-Z lower-cased; they are held as 64-bit hashes, of which
only the queries' are ever compared with the corpus.

Cases: null and empty texts have no term and count nowhere; queries without a
term that occurs give no rows; repeated query terms count repeatedly; rows that
repeat a document id are documents of their own; null document ids rank last
among equal scores; rows that repeat a query id each give their ranking; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightjar.llm.common import materialise, slices
from nightjar.llm.first_seen import NULL_ID
from nightjar.llm.wordhash import Words

#: Terms of a block of queries (a longer query is a block of its own).
BLOCK_TERMS = 1 << 17
#: Documents and postings that one step ranks together.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 13, 1 << 20
#: Groups that the tasks' best documents of a query meet in before the last one.
SALTS = 32
#: Saturation and length normalisation of the score, in percent and thousandths.
LENGTH_PERCENT = 75

BETWEEN = np.zeros(256, dtype=bool)
BETWEEN[:128] = True
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    BETWEEN[_a:_b + 1] = False


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit term hashes, first: row i has terms first[i]:first[i+1])."""
    words = Words(column, lower=True, separators=BETWEEN)
    return words.hash, words.first


def query_blocks(items: DataFrame, id_col: str, text_col: str, limit: int = BLOCK_TERMS) -> Iterator[list]:
    """Blocks of (query number, id, term hashes); queries pass the driver one
    after another, and a block holds at most ``limit`` terms."""
    block, size = [], 0
    rows = items.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"))
    for number, row in enumerate(rows.orderBy("i", "t").toLocalIterator()):
        hashes, _ = _terms(pa.array([row.t], type=pa.string()))
        if block and size + len(hashes) > limit:
            yield block
            block, size = [], 0
        block.append((number, row.i, hashes))
        size += len(hashes)
    if block:
        yield block


def postings(docs: DataFrame, vocabulary: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: its number of
    terms, the places in the sorted ``vocabulary`` of those it holds, and how
    often each occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, first = _terms(part.column("text"))
                n = np.diff(first)
                row = np.repeat(np.arange(len(n)), n)
                at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
                known = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
                pair, tf = np.unique(row[known] * np.int64(len(vocabulary) + 1) + at[known], return_counts=True)
                where, term = np.divmod(pair, np.int64(len(vocabulary) + 1))
                offsets = np.zeros(len(n) + 1, dtype=np.int32)
                np.cumsum(np.bincount(where, minlength=len(n)), out=offsets[1:])
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (term, tf)]
                out = pa.record_batch([part.column("doc_id"), pa.array(n.astype(np.int64)), *lists],
                                      names=["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n long, terms array<int>, tfs array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Query:
    """A query's terms rarest first, with their weights times repeats."""

    def __init__(self, number: int, item_id: int | None, places: np.ndarray, weights: np.ndarray, df: np.ndarray):
        self.number, self.item_id = number, item_id
        term, repeats = np.unique(places, return_counts=True)
        by = np.lexsort((term, df[term]))
        self.terms, self.weights = term[by], weights[term[by]] * repeats[by]


class Block:
    """Postings of some documents by term."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, first: np.ndarray, terms: np.ndarray, tfs: np.ndarray,
                 n_docs: int, n_terms: int):
        self.ids = ids
        m = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * n * n_docs) // n_terms
        doc = np.repeat(np.arange(len(ids)), np.diff(first))
        by = np.argsort(terms, kind="stable")  # documents stay ascending within a term
        tf = tfs[by].astype(np.int64)
        self.doc = doc[by]
        self.gain = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc])
        self.term, at = np.unique(terms[by], return_index=True)
        self.edges = np.append(at, len(by))
        self.most = np.maximum.reduceat(self.gain, at) if len(at) else np.zeros(0, np.int64)

    def rank(self, query: Query, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that may be among the k best; ``least``: a
        score that k documents elsewhere reach already."""
        at = np.minimum(np.searchsorted(self.term, query.terms), max(len(self.term) - 1, 0))
        here = self.term[at] == query.terms if len(self.term) else np.zeros(len(at), bool)
        at, weights = at[here], query.weights[here]
        bounds = np.cumsum((weights * self.most[at])[::-1])[::-1]  # of a term and all that follow
        score = np.zeros(len(self.ids), dtype=np.int64)
        have = np.zeros(len(self.ids), dtype=bool)
        survivors = None
        for i in range(len(at)):
            a, b = self.edges[at[i]], self.edges[at[i] + 1]
            docs, gain = self.doc[a:b], weights[i] * self.gain[a:b]
            if survivors is None:
                if bounds[i] < self._kth(score, have, k, least):
                    survivors = np.flatnonzero(have)
                else:
                    score[docs] += gain
                    have[docs] = True
                    continue
            # no new accumulators: only documents that have one are looked up
            if not len(survivors):
                break
            if len(survivors) * 8 < len(docs):
                place = np.minimum(np.searchsorted(docs, survivors), len(docs) - 1)
                hit = docs[place] == survivors
                score[survivors[hit]] += gain[place[hit]]
            else:
                hit = have[docs]
                score[docs[hit]] += gain[hit]
        found = np.flatnonzero(have & (score > 0) & (score >= least))
        return found, score[found]

    @staticmethod
    def _kth(score: np.ndarray, have: np.ndarray, k: int, least: int) -> int:
        held = score[have]
        return max(least, int(np.partition(held, len(held) - k)[len(held) - k])) if len(held) >= k else least


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((ids, -scores))[:k]
    return ids[by], scores[by]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        start = 0
        sizes = np.diff(batch.column("terms").offsets.to_numpy())
        total = np.append(0, np.cumsum(sizes))
        while start < batch.num_rows:
            end = int(np.searchsorted(total, total[start] + BLOCK_POSTINGS, side="right")) - 1
            end = max(start + 1, min(end, start + BLOCK_DOCS, batch.num_rows))
            part = batch.slice(start, end - start)
            terms, tfs = part.column("terms"), part.column("tfs")
            first = terms.offsets.to_numpy()
            ids = part.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            yield (ids, part.column("n").to_numpy(zero_copy_only=False), first - first[0],
                   terms.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False))
            start = end


def _rank_block(table: DataFrame, queries: list[Query], k: int, n_docs: int, n_terms: int) -> DataFrame:
    """Each task's k best documents of every query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = {q.number: (none, none) for q in queries}
        for arrays in _blocks(batches):
            block = Block(*arrays, n_docs, n_terms)
            for q in queries:
                ids, scores = best[q.number]
                least = int(scores[-1]) if len(scores) == k else 0
                found, score = block.rank(q, k, least)
                if len(found):
                    best[q.number] = _best(np.append(ids, block.ids[found]), np.append(scores, score), k)
        for q in queries:
            ids, scores = best[q.number]
            if len(ids):
                yield pa.record_batch([pa.array([q.number] * len(ids), type=pa.int64()),
                                       pa.array([q.item_id] * len(ids), type=pa.int64()),
                                       pa.array(ids), pa.array(scores)],
                                      names=["query", "item_id", "id", "score"])

    return table.mapInArrow(run, "query long, item_id long, id long, score long")


def _top(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k best rows of each group, ranked; groups are cut before they meet."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every query."""
    out = None
    for block in query_blocks(items, item_col, item_text_col):
        ranked = _search_block(docs, block, k, id_col, text_col)
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


def _search_block(docs: DataFrame, block: list, k: int, id_col: str, text_col: str) -> DataFrame:
    vocabulary = np.unique(np.concatenate([h for _, _, h in block]))
    table = materialise(postings(docs, vocabulary, id_col, text_col), "postings")
    n_docs, n_terms = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    # one count per term of this block of queries, at most BLOCK_TERMS
    for term, held in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[term] = held
    weights = np.array([weight(n_docs, int(x)) for x in df], dtype=np.int64)
    queries = [Query(number, item, np.searchsorted(vocabulary, h), weights, df) for number, item, h in block if len(h)]
    found = _rank_block(table, queries, k, n_docs, n_terms)
    # a query's documents meet by salt first, then a few rows per salt
    salted = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    few = _top(salted, k, "query", "salt").drop("rank")
    return _top(few, k, "query").select(
        "item_id", F.col("rank").cast("int").alias("rank"),
        F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "score")
