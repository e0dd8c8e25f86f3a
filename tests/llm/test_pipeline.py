import random

import pytest

from pyspark.sql import functions as F

import corpus_pipeline as C
from nightjar.llm.common import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with planted documents and labels."""
    rnd = random.Random(8)
    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ado", "ire", "une", "olt", "essa", "ind")]

    def prose(n):
        return [rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(n)]
    rows, toxic = [], []
    for i in range(300):
        t = prose(rnd.randint(60, 120))
        if i % 5 == 0:
            t[rnd.randrange(len(t))] = rnd.choice(["grubber", "vilecho"])
            t[rnd.randrange(len(t))] = rnd.choice(["grubber", "vilecho"])
            toxic.append(i)
        rows.append((i, "\n".join(" ".join(t[a:a + 20]) for a in range(0, len(t), 20)), f"s{i % 15}"))
    passage = " ".join(prose(60))
    near = prose(200)
    for i in range(400, 412):
        rows.append((i, " ".join(prose(70)) + "\nthe same line everywhere\n" + " ".join(prose(40)), f"s{i}"))
    for i in range(500, 505):
        rows.append((i, " ".join(prose(80)) + " " + passage + " " + " ".join(prose(80)), "s1"))
    for i in range(600, 606):
        t = list(near)
        t[rnd.randrange(200)] = "edit"
        rows.append((i, " ".join(t), "s2"))
    rows += [(700, None, None), (701, "", "s1"), (None, " ".join(prose(30)), None)]
    labels = [(i, 1, int(i in toxic)) for i in range(300)] + [(None, None, None), (600, 1, None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    full = [(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long") \
        .repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, toxic, passage


def test_stage_by_stage(spark, corpus):
    path, rows, toxic, passage = corpus
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in C.STAGES[:-1]:
        docs = materialise(stage(spark, docs, path), "stage")
        assert docs.columns == COLUMNS, name
        seen[name] = {r.doc_id: r for r in docs.collect()}
    everyone = {r[0] for r in rows}
    after = seen["toxicity"]
    assert not set(toxic) & set(after) and set(after) == everyone - set(toxic)
    lines = seen["line dedup"]
    assert set(lines) == set(after)
    assert [d for d in range(400, 412) if "everywhere" in lines[d].text] == [400]
    assert all(lines[d].text == after[d].text for d in after if d not in range(401, 412))
    assert lines[405].n_chars == len(lines[405].text)
    joined = seen["n-gram Jaccard join"]
    assert set(lines) - set(joined) == set(range(601, 606))
    cut = seen["substring dedup"]
    assert [d for d in range(500, 505) if passage in cut[d].text] == [500]
    assert set(cut) == set(joined)
    assert all(cut[d].text == joined[d].text for d in cut if d not in range(501, 505))
    packed = C.STAGES[-1][1](spark, docs, path).collect()
    assert {r.doc_id for r in packed} == set(cut)


def test_run_is_the_stages_in_order(spark, corpus):
    out = C.run(spark, corpus[0])
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert C.ORACLE_SQL is None and [n for n, _ in C.STAGES][0] == "toxicity"


def test_stages_on_extra_columns_and_empty_tables(spark, corpus):
    path = corpus[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    wide = docs.selectExpr("*", "1 as score", "2 as _had", "3 as _kept", "array(4) as factors", "5 as n_removed")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, wide.where("doc_id < 40 or doc_id >= 700"), path)
        assert out.columns == wide.columns, name
        assert {(r.n_removed, tuple(r.factors), r._had) for r in out.collect()} == {(5, (4,), 2)}, name
        assert stage(spark, docs.limit(0), path).count() == 0, name
    assert C.STAGES[-1][1](spark, docs.limit(0), path).count() == 0


def test_one_row_of_each_group_of_repeated_and_null_ids(spark):
    """Identical rows with one id, a copy under an id that another row has for
    its own text, and rows without an id that copy kept ones."""
    rnd = random.Random(4)
    a, b, c, d, e = (" ".join(f"{x}{rnd.randint(0, 9999)}" for _ in range(60)) for x in "abcde")
    rows = [(5, a), (5, a), (3, b), (6, b), (6, c), (None, d), (None, d), (None, e), (None, b), (8, e),
            (None, None), (9, ""), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = C.ngram_jaccard_join(spark, docs.withColumn("_row", F.lit(1)), "")
    assert out.columns == [*COLUMNS, "_row"]
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == sorted(
        [(5, a), (3, b), (6, c), (None, d), (8, e), (None, None), (9, ""), (9, "")], key=str)
