"""Operator 8: document fingerprints by consistent weighted sampling
(DataFrame functions only).

A document is a bag of words with their counts as weights.  Sample k of a
document is the term that minimises

    a = c / (y exp(r)),   y = exp(r (t - beta)),   t = floor(ln(w) / r + beta)

over its terms of weight w, where r and c are Gamma(2, 1) and beta is uniform,
all drawn from hashes of (term, k).  Two documents agree on a sample (term and
t) with a probability equal to their generalised Jaccard similarity, the sum
of the smaller over the sum of the larger weights.

With uniforms u1 .. u4, r = -ln(u1 u2) and c = -ln(u3 u4) are the gamma
variates, and beta = ln(u2) / ln(u1 u2) is uniform and independent of r.  Then

    t = floor((ln(w) - ln(u2)) / r)    and    a = c u1 exp(-r t),

where t = 0 for w = 1: one logarithm for most terms.

The rank of a and a name of (term, t) are packed in one long, and a document's
sample is the minimum of that: a plain aggregation with fixed buffers that
needs no shuffle where a document's rows are already together.
A term with the same weight in a document and in its edited text is evaluated
once for both.

Cases: null text counts as empty; an empty bag has the empty fingerprint, like
1 to another empty bag and 0 to any other; a null id counts as the largest id;
rows that repeat an id and its text are one document in several rows; equal
ids with different texts follow in the order of a hash of their texts; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightjar.llm.common import materialise
from nightjar.llm.first_seen import NULL_ID

#: The standard error of a likeness s is sqrt(s (1 - s) / SAMPLES), 0.05 at 0.8.
SAMPLES = 64
#: Samples drawn from one row; a term's row is repeated for each group of them,
#: which keeps the generated code small enough to be compiled well.
GROUP = 16
SPACE = "[\\x20\\x09-\\x0D]+"


def sample(term: Column, weight: Column, log_weight: Column, k: Column) -> Column:
    """The packed rank and name of a term's sample k under a weight >= 1."""
    first = F.xxhash64(term, k)
    second = F.xxhash64(first)

    def uniform(h: Column, at: int) -> Column:
        return (F.shiftrightunsigned(h, at).bitwiseAND(0xFFFFFFFF) + 0.5) / 4294967296.0
    u1, u2 = uniform(first, 0), uniform(first, 32)
    least = -F.log(uniform(second, 0) * uniform(second, 32)) * u1

    def packed(a: Column, name: Column) -> Column:
        return F.shiftleft(F.floor(a * float(1 << 36)), 20).bitwiseOR(name.bitwiseAND(0xFFFFF))
    r = -F.log(u1 * u2)
    t = F.floor((log_weight - F.log(u2)) / r)
    # t is 0 exactly when u1 < 1 / weight, so always for weight 1
    return F.when(weight * u1 < 1.0, packed(least, second)).otherwise(
        packed(least * F.exp(-r * t), second.bitwiseXOR(t * 0x9E377)))


def signatures(bags: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """One row per key with the signatures ``s_a`` and ``s_b`` (null for an
    empty bag): 16 bits of each sample's name.  bags: (keys, term long,
    a double, b double): a term once per key with its weights, whole numbers,
    in the key's two bags."""
    a, b = F.col("a"), F.col("b")
    # side 0: the same weight in both bags, evaluated once; 1 and 2: a's, b's
    sided = bags.select(*keys, "term", F.explode(
        F.when(a == b, F.array(F.struct(F.lit(0).alias("side"), a.alias("w"))))
        .when(b == 0, F.array(F.struct(F.lit(1).alias("side"), a.alias("w"))))
        .when(a == 0, F.array(F.struct(F.lit(2).alias("side"), b.alias("w"))))
        .otherwise(F.array(F.struct(F.lit(1).alias("side"), a.alias("w")),
                           F.struct(F.lit(2).alias("side"), b.alias("w"))))).alias("s"))
    dealt = sided.select(*keys, "term", "s.side", "s.w", F.log("s.w").alias("lw"),
                         F.explode(F.sequence(F.lit(0), F.lit(samples - 1), F.lit(GROUP))).alias("base"))
    mins = dealt.groupBy(*keys, "base", "side").agg(*[
        F.min(sample(F.col("term"), F.col("w"), F.col("lw"), F.col("base") + j)).alias(f"m_{j}") for j in range(GROUP)])
    bags_of = {"a": F.col("side") != 2, "b": F.col("side") != 1}
    parts = mins.groupBy(*keys, "base").agg(*[
        F.min(F.when(mine, F.col(f"m_{j}"))).alias(f"{n}_{j}") for n, mine in bags_of.items() for j in range(GROUP)])
    named = parts.select(*keys, "base", *[
        F.when(F.col(f"{n}_0").isNotNull(), F.array(*[_short(F.col(f"{n}_{j}")) for j in range(GROUP)]))
        .alias(f"p_{n}") for n in bags_of])
    # the groups of a key in order, one after another
    whole = named.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("base", "p_a", "p_b"))).alias("parts"))
    return whole.select(*keys, *[
        F.when(F.get("parts", F.lit(0))[f"p_{n}"].isNotNull(), F.flatten(F.col(f"parts.p_{n}"))).alias(f"s_{n}")
        for n in bags_of])


def _short(name: Column) -> Column:
    """The low 16 bits, shifted into the range of a short."""
    return (name.bitwiseAND(0xFFFF) - 0x8000).cast("short")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples, the estimate of generalised Jaccard."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda equal: equal))
    return (F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0)
            .otherwise(same / float(samples)))


def text_of(s: Column) -> Column:
    """A fingerprint as text: 16 bits of each sample's name in hex."""
    return F.coalesce(F.array_join(F.transform(
        s, lambda x: F.lower(F.lpad(F.hex(x.cast("int") + 0x8000), 4, "0"))), ""), F.lit(""))


def followers(ids: DataFrame) -> DataFrame:
    """Each (k, th) with the next one in order, the last with the first, as
    (nk, nth).  Ids are range partitioned and numbered in place; only the
    first id of each partition meets the others."""
    ranged = (ids.repartitionByRange("k", "th").sortWithinPartitions("k", "th")
              .withColumns({"at": F.monotonically_increasing_id(), "pid": F.spark_partition_id()}))
    ranged = materialise(ranged, "ordered-ids")
    heads = ranged.groupBy("pid").agg(F.min_by(F.struct("k", "th"), "at").alias("head"))
    ring = heads.select("pid", F.coalesce(F.lead("head").over(Window.orderBy("pid")),
                                          F.first("head").over(Window.orderBy("pid"))).alias("beyond"))
    inside = F.lead(F.struct("k", "th")).over(Window.partitionBy("pid").orderBy("at"))
    nxt = ranged.withColumn("next", inside).join(ring, "pid").withColumn("next", F.coalesce("next", "beyond"))
    return nxt.select(*ids.columns, F.col("next.k").alias("nk"), F.col("next.th").alias("nth"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, th, doc_id, n_chars, copies, nk, nth, common, mine, other) of each
    distinct (id, text): the text is ``common + mine``, the edited text, whose
    last quarter comes from the next text, ``common + other``.  ``common``
    ends at a space, so words never cross into the rest."""
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = keyed.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("k"), F.xxhash64("text").alias("th"), "text",
                         "doc_id")
    ids = (keyed.groupBy("k", "th").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("copies"),
                                        F.max(F.length("text")).cast("long").alias("n_chars")))
    nxt = materialise(followers(ids), "next-ids")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    # identical rows meet before the shuffle: a text is joined once
    texts = keyed.groupBy("k", "th").agg(F.first("text").alias("text"))
    head = (nxt.select("k", "th", "n_chars", "nk", "nth").withColumnsRenamed({"k": "k0", "th": "th0"})
            .join(texts.withColumnsRenamed({"k": "nk", "th": "nth"}), ["nk", "nth"])
            .select(F.col("k0").alias("k"), F.col("th0").alias("th"),
                    F.substring(F.col("text"), F.lit(1), quarter).alias("head")))
    stays = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - quarter)
    cut = (texts.join(nxt, ["k", "th"]).join(head, ["k", "th"])
           .withColumns({"stays": stays, "broken": F.substring_index(stays, " ", -1),
                         "tail": F.substring(F.col("text"), F.col("n_chars").cast("int") - quarter + 1, quarter)}))
    return cut.select("k", "th", "doc_id", "n_chars", "copies", "nk", "nth",
                      F.expr("left(stays, length(stays) - length(broken))").alias("common"),
                      F.concat("broken", "tail").alias("mine"), F.concat("broken", "head").alias("other"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The query's rows: fingerprints of every text and its edited text."""
    pairs = edited_pairs(docs, id_col, text_col)
    common, mine, other = (F.split(c, SPACE, -1) for c in ("common", "mine", "other"))
    # the numbers of words are columns below the generator, not above it
    split = pairs.select("k", "th", F.size(common).alias("n"), (F.size(common) + F.size(mine)).alias("m"),
                         F.concat(common, mine, other).alias("words"))
    both = split.select("k", "th", "n", "m", F.posexplode("words").alias("pos", "word"))
    bags = (both.where("word != ''")
            .select("k", "th", F.xxhash64("word").alias("term"),
                    (F.col("pos") < F.col("m")).cast("double").alias("a"),
                    ((F.col("pos") < F.col("n")) | (F.col("pos") >= F.col("m"))).cast("double").alias("b"))
            .groupBy("k", "th", "term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    signed = signatures(bags, ["k", "th"]).select("k", "th", "s_a", text_of(F.col("s_b")).alias("edited_fingerprint"),
                                                  likeness(F.col("s_a"), F.col("s_b")).alias("near_edited"))
    facts = pairs.select("k", "th", "doc_id", "n_chars", "copies", "nk", "nth",
                         F.sha2(F.concat("common", "other"), 256).alias("edited_sha256"))
    whole = materialise(facts.join(signed, ["k", "th"], "left"), "signatures")
    after = (whole.select("k", "th", "nk", "nth", "s_a")
             .join(whole.select(F.col("k").alias("nk"), F.col("th").alias("nth"), F.col("s_a").alias("s_next")),
                   ["nk", "nth"])
             .select("k", "th", likeness(F.col("s_a"), F.col("s_next")).alias("near_next")))
    # both empty: no sample, and alike
    return (whole.join(after, ["k", "th"])
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("doc_id", "n_chars", "edited_sha256", text_of(F.col("s_a")).alias("fingerprint"),
                    F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"),
                    F.coalesce("near_edited", F.lit(1.0)).alias("near_edited"), "near_next"))
