"""Operator 5: cross-site boilerplate lines by distinct-site spread.

A line (white space at its ends does not count) is boilerplate when it occurs
on ``min_sites`` distinct sites or more.  It stays in the document with the
smallest id that has it and goes from all others.

Every line hash carries a HyperLogLog sketch of its sites; sketches merge in
Spark's partial and final aggregation, so a line that is everywhere costs one
row per map task.  The estimate settles lines well above or below the
threshold; those within the sketch's error of it get an exact distinct count.

With ``excess``, the verdict does not depend on the size of the corpus: a line
must also be in ``min_docs`` documents and in ``excess`` times as many as lines
of its number of words would hold it by chance, were their words drawn one by
one from the corpus' other words.

Cases: null text has no lines; blank lines are never boilerplate; a null site
counts as a site with the empty name; rows with a null id lose every
boilerplate line unless all holders are such rows, which then keep it; rows
that repeat an id count as one document; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.llm.common import fresh, materialise

#: White space other than the line end itself.
BLANK = " \t\r\x0b\x0c"
#: What parts the words of a line when chance is reckoned.
NO_WORD = "[^\\p{L}\\p{M}\\p{N}]+"
_SEED = 42  # of Spark's xxhash64
_SALT = "second"
_SEED2 = xxhash.xxh64_intdigest(_SALT.encode(), seed=_SEED)


def _rows(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    rows = docs.select(*keep, F.explode(F.split(text, "\n", -1)).alias("line"))
    return rows.withColumn("line", F.trim("line", F.lit(BLANK))).where("line != ''")


def _lines(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    rows = _rows(docs, text, *keep)
    return rows.withColumns(_hashes(F.col("line"))).drop("line")


def _hashes(line: Column) -> dict[str, Column]:
    """Two 64-bit hashes of a line that do not depend on each other."""
    return {"h1": F.xxhash64(line), "h2": F.xxhash64(F.lit(_SALT), line)}


def spread(lines: DataFrame, min_sites: int, lg_k: int = 12) -> DataFrame:
    """(h1, h2, first) of the lines on min_sites sites or more; ``first`` is
    the smallest id that has the line.  lines: (doc, site, h1, h2)."""
    # four standard errors of the sketch, one site at least
    margin = max(1, math.ceil(4 * 1.04 / math.sqrt(1 << lg_k) * min_sites))
    sketched = (lines.groupBy("h1", "h2")
                .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"),
                     F.min("doc").alias("first"))
                .where(F.col("sites") >= min_sites - margin))
    sketched = materialise(sketched, "line-spread")
    near = sketched.where(F.col("sites") <= min_sites + margin)
    exact = (lines.join(near.select("h1", "h2", "first"), ["h1", "h2"])
             .groupBy("h1", "h2", "site").agg(F.min("first").alias("first"))
             .groupBy("h1", "h2").agg(F.count("*").alias("sites"), F.min("first").alias("first"))
             .where(F.col("sites") >= min_sites))
    return (sketched.where(F.col("sites") > min_sites + margin).select("h1", "h2", "first")
            .unionByName(exact.select("h1", "h2", "first")))


def beyond_chance(docs: DataFrame, text: Column, doc: Column, found: DataFrame, min_docs: int,
                  excess: float) -> DataFrame:
    """Those of the lines found, (h1, h2, first), that are in min_docs
    documents and in ``excess`` times as many as chance lets one expect.

    Of N lines with k words, N p1 ... pk are expected to be this one, where pi
    is the share of its word i among all words outside the line."""
    rows = _rows(docs, text, doc.alias("doc"))
    cut = F.filter(F.split(F.lower("line"), NO_WORD), lambda w: w != "")
    word = rows.select(F.explode(cut).alias("word")).select(F.xxhash64("word").alias("word"))
    counts = materialise(word.groupBy("word").agg(F.count("*").alias("c")), "words", narrow=True)
    total, most = counts.agg(F.sum("c"), F.max("c")).first()
    split = rows.select("doc", *[h.alias(n) for n, h in _hashes(F.col("line")).items()],
                        F.transform(cut, lambda w: F.xxhash64(w)).alias("words"))
    sizes = materialise(split.groupBy(F.size("words").alias("k")).agg(F.count("*").alias("alike")), "line-sizes",
                        narrow=True)
    # chance cannot matter beyond so many words, however common they are: no word
    # is more of what is left of the corpus without any one line's words
    lines, own = sizes.agg(F.coalesce(F.sum("alike"), F.lit(0)),
                           F.coalesce(F.max(F.col("alike") * F.col("k")), F.lit(0))).first()
    share = (min(1.0, most / (total - own)) if total > own else 1.0) if total else 0.0
    far = (2 ** 31 - 1 if share > 0.999 else
           max(1, math.ceil(math.log(max(1.0, excess * lines / min_docs)) / -math.log(share))) if share else 1)
    held = (split.withColumns({"k": F.size("words"), "words": F.when(F.size("words") <= far, F.col("words"))})
            .join(found, ["h1", "h2"])
            # dealt anew: a line in a third of all documents is not one task's
            .repartition("h1", "h2", "doc")
            .groupBy("h1", "h2", "doc").agg(F.count("*").alias("times"), F.first("first").alias("first"),
                                            F.first("k").alias("k"), F.first("words").alias("words"))
            .groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.sum("times").alias("times"),
                                     F.first("first").alias("first"), F.first("k").alias("k"),
                                     F.first("words").alias("words"))
            .where(F.col("docs") >= min_docs))
    held = materialise(held, "held-lines")
    # the line's own words do not speak for chance
    each = (held.where("words is not null and k > 0")
            .select("h1", "h2", "k", "times", F.explode("words").alias("word"))
            .groupBy("h1", "h2", "k", "times", "word").agg(F.count("*").alias("of"))
            .join(counts, "word")
            .withColumn("else", F.col("c") - F.col("times") * F.col("of"))
            .withColumn("logs", F.when(F.col("else") > 0, F.col("of") * F.log(
                F.col("else") / (F.lit(total or 1) - F.col("times") * F.col("k"))))))
    chance = (each.groupBy("h1", "h2", "k").agg(F.sum("logs").alias("logs"), F.min("else").alias("least"))
              .where("least > 0").join(sizes, "k")
              .select("h1", "h2", (F.exp("logs") * F.col("alike")).alias("expected")))
    return (held.join(chance, ["h1", "h2"], "left")
            .where(F.col("docs") >= excess * F.coalesce("expected", F.lit(0.0))).select("h1", "h2", "first"))


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text",
                       site_col: str = "source", excess: float | None = None, min_docs: int = 1) -> DataFrame:
    """Every row of ``docs`` without its boilerplate lines, plus ``n_lines``
    and ``n_removed`` (replaced where docs has columns of these names)."""
    outs = ["n_lines", "n_removed"]
    docs = docs.drop(*outs)
    names = docs.columns
    doc, doc2, gone = fresh(docs, "_doc", "_doc2", "_gone")
    keyed = docs.withColumn(doc, F.col(id_col).cast("long"))
    lines = _lines(keyed, F.col(text_col), F.col(doc).alias("doc"),
                   F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"))
    boilerplate = materialise(spread(lines, min_sites), "boilerplate")
    if excess is not None:
        boilerplate = materialise(beyond_chance(keyed, F.col(text_col), F.col(doc), boilerplate, min_docs, excess),
                                  "beyond-chance")
    hits = (lines.join(boilerplate, ["h1", "h2"])
            .where(~F.col("doc").eqNullSafe(F.col("first"))).groupBy("doc")
            .agg(F.collect_set(F.struct("h1", "h2")).alias(gone)))
    joined = keyed.join(hits.withColumnRenamed("doc", doc2),
                        F.col(doc).eqNullSafe(F.col(doc2)), "left").drop(doc2)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, lost = [], [], []
            for text, drop in zip(batch.column(text_col).to_pylist(), batch.column(gone).to_pylist(), strict=True):
                rows = [] if text is None else text.split("\n")
                total.append(len(rows))
                if drop:
                    drop = {(d["h1"], d["h2"]) for d in drop}
                    rows = [r for r in rows if not (s := r.strip(BLANK)) or _both(s) not in drop]
                lost.append(total[-1] - len(rows))
                texts.append(None if text is None else "\n".join(rows))
            yield pa.record_batch(
                [*(pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in names),
                 pa.array(total, pa.int64()), pa.array(lost, pa.int64())], names=[*names, *outs])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in outs)])
    return joined.mapInArrow(cut, schema)


def _both(line: str) -> tuple[int, int]:
    """Spark's two hashes of a line."""
    data = line.encode()
    return tuple(h - (1 << 64) if h >> 63 else h
                 for h in (xxhash.xxh64_intdigest(data, seed=s) for s in (_SEED, _SEED2)))
