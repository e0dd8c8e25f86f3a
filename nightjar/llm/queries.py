"""Registered queries: the operators with production parameters, each over
its whole table, returning the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.llm.common import table

#: Folder-free name of the public vocabulary that queries 7 and 10 use.
VOCABULARY = "byte_bpe_50k.json"

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = (fn, sql)
        return fn
    return add


@query("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nightjar.llm.substring import remove_repeats
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=20, layout=False)
    return cut.select("doc_id", "n_words", "n_removed",
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op2_ngram_jaccard_join")
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nightjar.llm.ngram_join import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nightjar.llm.quality import judge
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "quality")


@query("op4_warc_index_merge")
def op4_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nightjar.llm.warc import capture_index
    # the table has no capture times: one a second, in the order of ids
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html").withColumn(
        "captured", F.timestamp_seconds(1704067200 + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))))
    index = capture_index(pages, date_col="captured", min_bytes=1000)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured")


OP5_MIN_SITES = 10


@query("op5_line_spread", f"""
with l as (
  select doc_id, coalesce(source, '') as site, i, x, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as t
  from (select doc_id, source, unnest(string_split(text, chr(10))) as x,
               generate_subscripts(string_split(text, chr(10)), 1) as i
        from documents)),
b as (select t, min(doc_id) as first from l where t <> '' group by t
      having count(distinct site) >= {OP5_MIN_SITES}),
k as (select l.doc_id, count(*) as n_lines, count(b.t) filter (where l.doc_id <> b.first) as n_removed,
             string_agg(l.x, chr(10) order by l.i) filter (where b.t is null or l.doc_id = b.first) as kept
      from l left join b on l.t = b.t group by l.doc_id)
select d.doc_id, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_removed, 0) as n_removed,
       sha256(coalesce(k.kept, '')) as kept_sha256
from documents d left join k using (doc_id)""")
def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nightjar.llm.lines import remove_boilerplate
    cut = remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), OP5_MIN_SITES)
    return cut.select("doc_id", "n_lines", "n_removed",
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The contract's rules; fixed values.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


@query("op6_url_trees")
def op6_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nightjar.llm.url_filter import judge, parsed, train
    urls = parsed(table(spark, sf_dir, "pages"), URL_RULES)
    return judge(urls, train(urls)).select("page_id", "host", "path", "rule", "verdict")


@query("op7_bin_slack_packing")
def op7_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nightjar.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), vocabulary_path(), capacity=2048, end_id=0)


@query("op8_weighted_sampling")
def op8_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nightjar.llm.weighted_sampling import fingerprints
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nightjar.llm.toxicity import add_score, fold, train
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = add_score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op10_bpe_round_trip")
def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nightjar.llm.common import id_text
    from nightjar.llm.tokens import token_digests
    return token_digests(id_text(table(spark, sf_dir, "documents"), "doc_id", "text"), vocabulary_path())


@query("op11_anchor_expansion")
def op11_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nightjar.llm.common import id_text
    from nightjar.llm.pii import BASE, add_spans, base_only, count_of, listed
    found = add_spans(id_text(table(spark, sf_dir, "documents"), "doc_id", "text"), keep_text=False)
    spans = F.col("spans")
    return found.select(
        "doc_id", *[count_of(spans, k).alias(f"n_{k}") for k in BASE],
        F.sha2(listed(base_only(spans)), 256).alias("base_sha256"), listed(spans).alias("spans"))


@query("op13_limited_accumulators", """
with t as (
  select d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ts
  from (select row_number() over () as d, doc_id, text from documents)),
n as (select d, doc_id, len(ts) as n from t where len(ts) > 0),
c as (select count(*) as docs, sum(n)::bigint as terms from n),
m as (select d, doc_id, 100 - 75 + (75 * n * docs) // terms as m from n, c),
p as (select d, term, count(*) as tf from (select d, unnest(ts) as term from t) group by d, term),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
      from p, c group by term, docs),
q as (select item_id, term, count(*) as repeats
      from (select item_id, unnest(regexp_extract_all(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark)
      group by item_id, term),
s as (select item_id, d, m.doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
      from q join w using (term) join p using (term) join m using (d) group by item_id, d, m.doc_id),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
      from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10""")
def op13_limited_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nightjar.llm.ranked_search import search
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query("op12_prefix_trie")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nightjar.llm.prefix_trie import conversation_trie
    return conversation_trie(table(spark, sf_dir, "conversations"))
