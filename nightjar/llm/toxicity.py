"""Operator 9: toxicity by a factorization machine over hashed terms.

Terms are a text's lower-cased words and their first four, five and six
bytes, hashed into ``2**BITS`` buckets.  The model scores a document as

    w0 + sum of w[i] + sum over pairs i < j of <v[i], v[j]>

so a pair of terms can weigh more, or less, than the two alone.  It is fitted
by Adam on at most ``max_train`` labelled documents (those with the least id
hash), the only rows that reach the driver, as bucket numbers.  Buckets that
tell the classes apart (by likelihood ratio) become the model's
features; ``max_features`` and ``rank`` bound the model, which is all that is
sent to the executors.  Scoring is one narrow pass over whole texts.

Cases: null and empty texts have no terms and score the intercept; a null id
or a null label never trains; ids labelled twice count with their highest
label; without a label of each class the score is the base rate; repeated
rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.llm.common import slices
from nightjar.llm.wordhash import Words

BITS = 18
PREFIXES = (4, 5, 6)
#: Likelihood ratio that a feature needs (chi-square, one degree, 0.001).
MIN_RATIO = 10.83

_WORD_BREAK = np.ones(256, dtype=bool)
_WORD_BREAK[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1),
             *range(0x80, 0x100)]] = False


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 is held out from training."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) pairs of a slice, each once, sorted."""
    w = Words(texts, lower=True, separators=_WORD_BREAK)
    doc = np.repeat(np.arange(len(w.first) - 1), w.count())
    size = w.end - w.start
    pairs = [(doc, w.hash)]
    for k in PREFIXES:
        long = size > k
        pairs.append((doc[long], w.piece(w.start[long], w.start[long] + k) ^ np.uint64(k)))
    code = np.unique(np.concatenate([(d.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS))
                                     for d, h in pairs]))
    return (code >> np.uint64(BITS)).astype(np.int64), (code & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    bias: float
    index: np.ndarray      # bucket -> feature, -1 for none
    weight: np.ndarray     # per feature
    factors: np.ndarray    # feature x rank

    def raw(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Scores before the logistic of n documents."""
        feature = self.index[bucket]
        doc, feature = doc[feature >= 0], feature[feature >= 0]
        out = self.bias + np.bincount(doc, self.weight[feature], n)
        for column in self.factors.T:
            v = column[feature]
            out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*terms(texts), len(texts)), -40, 40)))


def fit(doc: np.ndarray, bucket: np.ndarray, label: np.ndarray, max_features: int = 4096, rank: int = 4,
        epochs: int = 25, seed: int = 7) -> Model:
    """Fit on (document, bucket) pairs sorted by document."""
    n = len(label)
    rate = (label.sum() + 0.5) / (n + 1)
    index = np.full(1 << BITS, -1, dtype=np.int32)
    empty = Model(float(np.log(rate / (1 - rate))), index, np.zeros(0), np.zeros((0, rank)))
    if not n or label.min() == label.max():
        return empty
    pos = np.bincount(bucket, label[doc], 1 << BITS)
    neg = np.bincount(bucket, minlength=1 << BITS) - pos
    # likelihood ratio of each bucket's two class counts against independence
    seen, total = pos + neg, label.sum()
    expected = seen * (total / n)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(pos > 0, pos * np.log(pos / expected), 0)
                     + np.where(neg > 0, neg * np.log(neg / (seen - expected)), 0))
    chosen = np.argsort(-ratio, kind="stable")[:max_features]
    chosen = chosen[ratio[chosen] > MIN_RATIO]
    if not len(chosen):
        return empty
    index[chosen] = np.arange(len(chosen))
    feature = index[bucket]
    doc, feature = doc[feature >= 0], feature[feature >= 0]
    first = np.searchsorted(doc, np.arange(n + 1))

    rng = np.random.default_rng(seed)
    m = len(chosen)
    theta = np.concatenate([np.zeros((m, 1)), rng.normal(0, 0.05, (m, rank))], axis=1)
    bias = empty.bias
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    bias_mean = bias_square = 0.0
    step = 0
    for epoch in range(epochs):
        rate = 0.05 / (1 + 0.1 * epoch)
        for batch in np.array_split(rng.permutation(n), max(1, n // 256)):
            step += 1
            counts = first[batch + 1] - first[batch]
            row = np.repeat(np.arange(len(batch)), counts)
            at = np.repeat(first[batch] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
            f = feature[at]
            t = theta[f]
            sums = np.stack([np.bincount(row, t[:, k], len(batch)) for k in range(rank + 1)], axis=1)
            squares = np.bincount(row, (t[:, 1:] ** 2).sum(axis=1), len(batch))
            raw = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - label[batch]) / len(batch)
            each = error[row][:, None] * np.concatenate([np.ones((len(row), 1)), sums[row, 1:] - t[:, 1:]], axis=1)
            used, where = np.unique(f, return_inverse=True)
            grad = np.stack([np.bincount(where, each[:, k], len(used)) for k in range(rank + 1)], axis=1).astype(float)
            grad += 1e-4 * theta[used]
            mean[used] = 0.9 * mean[used] + 0.1 * grad
            square[used] = 0.999 * square[used] + 0.001 * grad ** 2
            pace = np.sqrt(square[used] / (1 - 0.999 ** step)) + 1e-8
            theta[used] -= rate * (mean[used] / (1 - 0.9 ** step)) / pace
            g = error.sum()
            bias_mean, bias_square = 0.9 * bias_mean + 0.1 * g, 0.999 * bias_square + 0.001 * g * g
            bias -= rate * (bias_mean / (1 - 0.9 ** step)) / (np.sqrt(bias_square / (1 - 0.999 ** step)) + 1e-8)
    return Model(float(bias), index, theta[:, 0].copy(), theta[:, 1:].copy())


def train(docs: DataFrame, labels: DataFrame, max_train: int = 12_000, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the labelled rows outside the held-out fold."""
    chosen = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label"))
              .where("doc_id is not null and label is not null").where(fold(F.col("doc_id")) != 1)
              .groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    # at most max_train (id, label) rows, fetched so that the bound is a fact
    spark = docs.sparkSession
    rows = [(r["doc_id"], r["label"]) for r in chosen.collect()]
    chosen = spark.createDataFrame(rows, "doc_id long, label double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                doc, bucket = terms(part.column("text"))
                offsets = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.record_batch([part.column("doc_id"), part.column("label"),
                                       pa.ListArray.from_arrays(pa.array(offsets), pa.array(bucket.astype(np.int32)))],
                                      names=["doc_id", "label", "terms"])

    found = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
             .join(F.broadcast(chosen), "doc_id")
             .mapInArrow(run, "doc_id long, label double, terms array<int>").toArrow())
    found = found.sort_by("doc_id").combine_chunks()
    lists = found.column("terms").combine_chunks()
    counts = np.diff(lists.offsets.to_numpy())
    return fit(np.repeat(np.arange(len(counts)), counts), lists.flatten().to_numpy().astype(np.int64),
               found.column("label").to_numpy())


def add_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability of the label in ``score_col``."""
    names = [c for c in docs.columns if c != score_col]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                score = held.value.score(part.column(text_col))
                yield pa.record_batch([*(part.column(c) for c in names), pa.array(score)], names=[*names, score_col])

    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(score_col, T.DoubleType())])
    return docs.select(*names).mapInArrow(run, schema)
