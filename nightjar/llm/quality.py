"""Operator 3: quality rules as weak supervision (DataFrame functions only).

Each rule votes good or bad on a document, or abstains.  Nobody has labelled
the documents: expectation-maximisation estimates every rule's accuracy on
good and on bad documents from how the votes agree, and a document is kept by
its posterior probability of being good, not by passing every rule.

The votes of all documents are counted by pattern; with R rules there are at
most 3**R patterns, which is all that the driver sees.  The posterior is an
expression over the vote columns, so scoring stays in the JVM.

Cases: null or empty text has no words, lines or symbols and fails the base
rules; rows are independent apart from the estimated accuracies, so ids may be
null or repeat; an empty table gives an empty result (and prior accuracies).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar.llm.common import materialise

SPACE = "[\\x20\\x09-\\x0D]+"
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: (name, value, bad from, good up to): votes bad at the first bound or above,
#: good at the second or below, else abstains.  Values are shares of a document.
#: Every kind of defect is seen by two rules or more: accuracies are estimated
#: from agreement, so a rule that nothing can agree with would count for little.
RULES = (
    ("short", "20 / greatest(n_words, 1)", 1.0, 0.4),
    ("symbols", "n_symbols / greatest(n_words, 1)", 0.3, 0.05),
    ("symbol_runs", "n_symbol_runs / greatest(n_words, 1)", 0.25, 0.05),
    ("symbol_chars", "n_symbols / greatest(word_chars, 1)", 0.08, 0.02),
    ("repeats", "n_repeat_words / greatest(n_words, 1)", 0.2, 0.02),
    ("dup_lines", "n_dup_lines / greatest(n_lines, 1)", 0.3, 0.1),
    ("monotony", "1 - n_distinct / greatest(least(n_words, 500), 1)", 0.6, 0.45),
    ("long_words", "abs(word_chars / greatest(n_words, 1) - 5.5) / 5.5", 0.75, 0.4),
    ("capitals", "n_capitals / greatest(word_chars, 1)", 0.3, 0.12),
    ("shouting", "n_marks / greatest(n_words, 1)", 0.25, 0.1),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression once, so that lambdas do not evaluate it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def _repeat_words(words: Column) -> Column:
    """Words covered by a WINDOW-word window that occurs twice or more."""
    def count(hashes: Column) -> Column:
        # equal hashes become neighbours; a window with an equal neighbour repeats
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def covered(s: Column) -> Column:
            def repeats(e: Column, k: Column) -> Column:
                before = F.when(k > 0, F.get(s, k - 1)["h"] == e["h"]).otherwise(False)
                after = F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))
                return before | after
            places = F.array_sort(F.transform(F.filter(s, repeats), lambda e: e["p"]))
            return F.aggregate(
                places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"),
                                      (p + WINDOW).alias("end")),
                lambda a: a["n"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, covered))

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(
            _let(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW)))), count))
    return _let(words, windows)


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus the counts that rules judge (existing columns of these
    names are replaced)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE, -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(BLANK)) != "")
    return docs.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": _without(text, SPACE).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_symbol_runs": (F.size(F.split(text, f"[{SYMBOLS}]+", -1)) - 1).cast("long"),
        "n_distinct": F.size(F.array_distinct(words)).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeat_words(words).cast("long"),
        "n_capitals": (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
        "n_marks": (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long"),
    })


def votes(measured: DataFrame) -> DataFrame:
    """Add one column ``vote_<rule>`` each: 1 good, -1 bad, 0 abstains."""
    return measured.withColumns({
        f"vote_{name}": F.expr(f"case when {value} >= {bad} then -1 when {value} <= {good} then 1 else 0 end")
        for name, value, bad, good in RULES})


#: What is assumed of a rule and of the corpus before any vote is seen: a rule
#: seldom accuses a good document and finds a part of the bad ones.
PRIOR, ON_GOOD, ON_BAD, PSEUDO = 0.8, 0.98, 0.3, 20.0


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, list[tuple[float, float]]]:
    """(share of good documents, [(accuracy on good, accuracy on bad)]) by
    expectation-maximisation over counted vote patterns.  A rule is taken to
    accuse bad documents more often than good ones, which also tells the two
    classes apart."""
    rules = len(RULES)
    prior, accuracy = PRIOR, [(ON_GOOD, ON_BAD)] * rules
    n = np.array([count for _, count in patterns], dtype=float)
    vote = np.array([pattern for pattern, _ in patterns], dtype=np.int8).reshape(len(patterns), rules)
    up, down = (vote > 0).astype(float), (vote < 0).astype(float)
    total = n.sum()
    for _ in range(rounds if total else 0):
        base, each = weights(prior, accuracy)
        for_good, for_bad = np.array(each).T
        p = 1 / (1 + np.exp(-(base + up @ for_good + down @ for_bad)))
        good, bad = n * p, n * (1 - p)
        # votes weighted by class: right and all on good, right and all on bad
        right, every = good @ up, good @ (up + down)
        caught, accusable = bad @ down, bad @ (up + down)
        prior = float(np.clip((PSEUDO * PRIOR + good.sum()) / (total + PSEUDO), 0.05, 0.95))
        on_good = np.clip((PSEUDO * ON_GOOD + right) / (PSEUDO + every), 0.6, 0.999)
        on_bad = np.minimum(0.999, np.maximum(np.maximum(0.02, 1 - on_good + 0.01),
                                              (PSEUDO * ON_BAD + caught) / (PSEUDO + accusable)))
        accuracy = list(zip(on_good.tolist(), on_bad.tolist(), strict=True))
    return prior, accuracy


def weights(prior: float, accuracy: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """Log odds: of a good document, and of each rule's good and bad vote."""
    return (math.log(prior / (1 - prior)),
            [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in accuracy])


def posterior(pattern: tuple[int, ...], prior: float, accuracy: list[tuple[float, float]]) -> float:
    base, each = weights(prior, accuracy)
    odds = base + sum((w[0] if v > 0 else w[1]) for w, v in zip(each, pattern, strict=True) if v)
    return 1 / (1 + math.exp(-odds))


def judge(docs: DataFrame, text_col: str = "text", min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """``docs`` (without the text) plus measures, votes, ``base_failed``,
    ``quality`` (the posterior) and ``kept``."""
    voted = materialise(votes(measures(docs, text_col).drop(text_col)), "quality-votes")
    names = [f"vote_{r[0]}" for r in RULES]
    counted = voted.groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most 3 ** len(RULES) rows
    # EM sums run in a fixed order
    found = sorted((tuple(r[c] for c in names), r["n"]) for r in counted)
    base, each = weights(*estimate(found))
    odds = F.lit(base)
    for name, (good, bad) in zip(names, each, strict=True):
        odds = odds + F.when(F.col(name) > 0, good).when(F.col(name) < 0, bad).otherwise(0.0)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return (voted.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-odds)))
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)))
