"""The corpus pipeline: documents in, packed training sequences out.

Each stage calls one operator of ``nightjar.llm`` on all that the stage before
kept; its decisions take effect.  All but the last return the columns of
``documents``; the last returns the packed pieces.

Stages accept nulls in any column, empty and very long texts, repeated rows,
an empty table and extra columns; each operator's docstring says what becomes
of them.  A document that a stage leaves without any word is dropped if it had
words before; documents that come without words stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.llm.common import fresh, materialise, table
from nightjar.llm.lines import remove_boilerplate
from nightjar.llm.ngram_join import near_duplicates
from nightjar.llm.packing import pack
from nightjar.llm.queries import vocabulary_path
from nightjar.llm.substring import remove_repeats
from nightjar.llm.toxicity import add_score, train

#: A document is rejected from this probability on.
TOXIC = 0.7
#: A line on so many distinct sites, in so many documents, is boilerplate ...
MIN_SITES, MIN_DOCS = 5, 10
#: ... if it is in so many times the documents that chance lets one expect.
EXCESS = 10
#: Near duplicates: words of a shingle, similarity num / den.
SHINGLE, NUM, DEN = 5, 4, 5
#: Consecutive words that make a repeated passage.
PASSAGE = 40
#: Tokens of a sequence.
CAPACITY = 2048

_WORD = "[^\\x20\\x09-\\x0D]"


def _shorten(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], *made: str) -> DataFrame:
    """``docs`` after an operator that shortens ``text``, with the columns of
    docs; rows that lost their last word are dropped.  Columns of docs named
    like those that the operator makes are set aside meanwhile."""
    columns = docs.columns
    had, *aside = fresh(docs, "_had", *(f"_{c}" for c in columns))
    held = {c: (a if c.lower() in made else c) for c, a in zip(columns, aside, strict=True)}
    cut = operator(docs.withColumnsRenamed(held).withColumn(had, _had_words()))
    kept = cut.where(~F.col(had) | _had_words())
    if "n_chars" in columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select([F.col(held[c]).alias(c) for c in columns])


def _had_words() -> Column:
    return F.coalesce(F.col("text").rlike(_WORD), F.lit(False))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not reject."""
    score, = fresh(docs, "_score")
    model = train(docs, table(spark, sf_dir, "labels"))
    return add_score(docs, model, score_col=score).where(F.col(score) < TOXIC).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate across sites."""
    return _shorten(docs, lambda d: remove_boilerplate(d, MIN_SITES, excess=EXCESS, min_docs=MIN_DOCS),
                    "n_lines", "n_removed")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of every group of near duplicates, the
    first of them if rows repeat that id; rows without an id come last."""
    row, = fresh(docs, "_row")
    # numbered once, in a written table: a row keeps its number when read again
    docs = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    near = near_duplicates(docs, SHINGLE, NUM, DEN, id_col=row)
    ids = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"))
    # ids and kept rows grow with the corpus: never broadcast
    first = (near.join(ids.hint("merge"), near["doc_id"] == ids["row"]).groupBy("component_id")
             .agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("first")))
    kept = materialise(first.select(F.col("first.row").alias("_kept")), "kept", narrow=True)
    return docs.join(kept.hint("merge"), docs[row] == kept["_kept"], "left_semi").drop(row)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    return _shorten(docs, lambda d: remove_repeats(d, PASSAGE), "n_words", "n_removed", "factors")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their place in sequences."""
    return pack(docs, vocabulary_path(), CAPACITY, 0)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("n-gram Jaccard join", ngram_jaccard_join),
          ("substring dedup", substring_dedup), ("best-fit packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The factorization machine and the packing plan are beyond SQL.
ORACLE_SQL = None
