"""Operator 6: URL filters by gradient-boosted trees on lexical features.

Block and allow rules label the URLs that they fit (the longest wins); trees
trained on those labels judge the rest.  Features are lexical: lengths, path
depth, digit ratio, entropy, parameter counts, and suffix statistics, the
smoothed share of blocked labels per host suffix, host and first path segment
over all labelled URLs.  Statistics are kept per hash bucket (``BUCKETS`` each,
2 MB a statistic), which bounds what is sent to the executors whatever the
hosts.  The trees are fitted on at most ``max_train`` distinct labelled URLs,
those with the least hash, weighted by 1 + ln(rows); what they see of the
statistics there is out of fold: counted over the URLs of the other ``FOLDS``
- 1 folds, so that no URL's own label is among its features.

Cases: a null url, or one without "://", has an empty host and path, fits no
rule and is judged by the trees; without labels of both verdicts the trees
give the more frequent one (allow if there are none); ids may be null or
repeat, rows are independent; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar.llm.common import emit

BUCKETS = 1 << 18
FOLDS = 5
STATISTICS = ("tld", "suffix", "host", "segment")
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty without "://"."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.regexp_extract(url, _URL, 2)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls.  Rules are
    "host/path prefix" to "block" or "allow"; a host covers its subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=len):  # the longest is tested first: it ends up outermost
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, rules[text]).otherwise(verdict)
    return rule, verdict


def _bucket(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) % BUCKETS


def _places(hosts: list[str], paths: list[str]) -> np.ndarray:
    """Bucket of each URL's TLD, two-label suffix, host and first segment."""
    out = np.empty((len(hosts), len(STATISTICS)), dtype=np.int64)
    for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        labels = h.rsplit(".", 2)
        out[i] = (_bucket(labels[-1]), _bucket(".".join(labels[-2:])), _bucket(h), _bucket(p[1:].split("/", 1)[0]))
    return out


_WORD = re.compile("[a-z]+")
_VOWEL = re.compile("[aeiou]")


def lexical(urls: list[str], hosts: list[str], paths: list[str]) -> np.ndarray:
    """Features that need the URL alone."""
    n = len(urls)
    raw = np.frombuffer("".join(urls).encode("utf-8", "replace"), dtype=np.uint8)
    size = np.array([len(u.encode("utf-8", "replace")) for u in urls], dtype=np.int64)
    row = np.repeat(np.arange(n), size)
    counts = np.bincount(row * 256 + raw, minlength=n * 256).reshape(n, 256)
    total = np.maximum(size, 1)[:, None]
    share = counts / total
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    digits = counts[:, ord("0"):ord("9") + 1].sum(axis=1) / total[:, 0]
    depth = np.array([p.count("/") for p in paths])
    host = np.array([len(h) for h in hosts])
    dots = np.array([h.count(".") for h in hosts])
    vowels = np.array([len(_VOWEL.findall(h)) / max(1, len(h)) for h in hosts])
    tail = np.array([len(p.rsplit("/", 1)[-1]) for p in paths])
    secure = np.array([u[:6].lower() == "https:" for u in urls])
    return np.column_stack([size, depth, digits, entropy, counts[:, ord("=")], counts[:, ord("&")],
                            counts[:, ord("?")], counts[:, ord("-")], counts[:, ord("%")], host, dots, vowels, tail,
                            secure]).astype(np.float64).reshape(n, -1)


@dataclass
class Trees:
    """Boosted regression trees in arrays: per tree, node k has children
    2k + 1 and 2k + 2."""
    bias: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    bound: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        every = np.arange(len(x))
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while (inner := node < len(feature)).any():
                at = every[inner]
                k = node[at]
                node[at] = 2 * k + 1 + (x[at, feature[k]] > bound[k])
            out += leaf[node - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 40, depth: int = 3,
          rate: float = 0.2, bins: int = 32) -> Trees:
    """Second-order boosting of the logistic loss on quantile histograms."""
    weight = np.ones(len(y)) if weight is None else weight
    share = ((weight * y).sum() + 0.5) / (weight.sum() + 1)
    model = Trees(bias=float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    raw = np.full(len(y), model.bias)
    inner = 2 ** depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, hessian = weight * (p - y), weight * p * (1 - p)
        feature, bound = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for k in range(inner):
            at = np.flatnonzero(node == k)
            best = (1e-9, 0, np.inf, None)
            g0, h0 = gradient[at].sum(), hessian[at].sum()
            for j, e in enumerate(edges):
                if len(at) and len(e):
                    g = np.cumsum(np.bincount(binned[at, j], gradient[at], len(e) + 1))[:-1]
                    h = np.cumsum(np.bincount(binned[at, j], hessian[at], len(e) + 1))[:-1]
                    gain = g * g / (h + 1) + (g0 - g) ** 2 / (h0 - h + 1) - g0 * g0 / (h0 + 1)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (float(gain[i]), j, float(e[i]), binned[at, j] > i)
            feature[k], bound[k] = best[1], best[2]
            node[at] = 2 * k + 1 + (best[3] if best[3] is not None else 0)
        last = node - inner
        leaf = -rate * np.bincount(last, gradient, inner + 1) / (np.bincount(last, hessian, inner + 1) + 1)
        raw = raw + leaf[last]
        model.feature.append(feature)
        model.bound.append(bound)
        model.leaf.append(leaf)
    return model


@dataclass
class UrlModel:
    rates: np.ndarray  # statistics x BUCKETS: smoothed share of blocked labels
    trees: Trees

    def features(self, urls: list[str], hosts: list[str], paths: list[str]) -> np.ndarray:
        places = _places(hosts, paths)
        return np.column_stack([lexical(urls, hosts, paths), self.rates[np.arange(len(STATISTICS)), places]])

    def block(self, urls: list[str], hosts: list[str], paths: list[str]) -> np.ndarray:
        return self.trees.raw(self.features(urls, hosts, paths)) > 0


def parsed(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, host, path, rule, label)."""
    host, path = split_url(F.col(url_col))
    out = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                       host.alias("host"), path.alias("path"))
    rule, label = rule_of(F.col("host"), F.col("path"), rules)
    return out.withColumns({"rule": rule, "label": label})


def _fold(urls: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(u.encode(), seed=1) % FOLDS for u in urls], dtype=np.int64)


def _smoothed(blocked: np.ndarray, n: np.ndarray, prior: float) -> np.ndarray:
    return (blocked + 5 * prior) / (n + 5)


def train(urls: DataFrame, max_train: int = 20_000) -> UrlModel:
    """Fit on the labelled rows of (url, host, path, label)."""
    width = len(STATISTICS) * BUCKETS

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"fold": pa.int32(), "place": pa.int32(), "n": pa.int64(), "blocked": pa.int64()}
        for batch in batches:
            where = _places(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            where = where + np.arange(len(STATISTICS)) * BUCKETS
            bad = np.array(batch.column("label").to_pylist()) == "block"
            where += (_fold(batch.column("url").to_pylist()) * width)[:, None]
            at, back, n = np.unique(where.ravel(), return_inverse=True, return_counts=True)
            blocked = np.bincount(back, np.repeat(bad, len(STATISTICS)), len(at)).astype(np.int64)
            yield emit({"fold": (at // width).astype(np.int32), "place": (at % width).astype(np.int32), "n": n,
                        "blocked": blocked}, types)

    labelled = urls.where("label is not null").select("url", "host", "path", "label")
    # at most FOLDS x statistics x BUCKETS rows of four numbers
    counted = (labelled.mapInArrow(tally, "fold int, place int, n long, blocked long")
               .groupBy("fold", "place").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).toArrow())
    fold, place = (counted.column(c).to_numpy().astype(np.int64) for c in ("fold", "place"))
    n, blocked = (np.zeros((FOLDS, width)) for _ in range(2))
    n[fold, place], blocked[fold, place] = counted.column("n").to_numpy(), counted.column("blocked").to_numpy()
    first = slice(0, BUCKETS)  # every labelled row is in one bucket of the first statistic
    prior = (blocked[:, first].sum() + 1) / (n[:, first].sum() + 2)
    every_n, every_blocked = n.sum(axis=0), blocked.sum(axis=0)
    model = UrlModel(_smoothed(every_blocked, every_n, prior).reshape(len(STATISTICS), BUCKETS), Trees())
    rows = (labelled.groupBy("url", "host", "path", "label").agg(F.count("*").alias("rows"))
            .orderBy(F.xxhash64("url"), "url", "label").limit(max_train).collect())
    if rows:
        texts = [[r[c] for r in rows] for c in ("url", "host", "path")]
        at = _places(*texts[1:]) + np.arange(len(STATISTICS)) * BUCKETS
        own = _fold(texts[0])[:, None]
        outside = _smoothed(every_blocked[at] - blocked[own, at], every_n[at] - n[own, at], prior)
        model.trees = boost(np.column_stack([lexical(*texts), outside]),
                            np.array([float(r["label"] == "block") for r in rows]),
                            1 + np.log([r["rows"] for r in rows]))
    else:
        model.trees.bias = -1.0
    return model


def judge(urls: DataFrame, model: UrlModel) -> DataFrame:
    """``urls`` with ``verdict``: the label where there is one, else the trees'."""
    names = urls.columns
    held = urls.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.column("label").to_pylist()
            at = [i for i, v in enumerate(out) if v is None]
            if at:
                part = batch.take(pa.array(at))
                block = held.value.block(*(part.column(c).to_pylist() for c in ("url", "host", "path")))
                for i, b in zip(at, block, strict=True):
                    out[i] = "block" if b else "allow"
            yield pa.record_batch([*batch.columns, pa.array(out, pa.string())], names=[*names, "verdict"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields)
    return urls.mapInArrow(run, f"{schema}, verdict string")
