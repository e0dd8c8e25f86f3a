import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from nightjar.llm.queries import QUERIES
from nightjar.llm.toxicity import Model, add_score, fit, fold, terms, train


def corpus(n=600, seed=3):
    rnd, rows, labels = random.Random(seed), [], []
    plain = [f"word{i}" for i in range(200)]
    for i in range(n):
        t = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))]
        toxic = rnd.random() < 0.3
        if toxic:
            t[rnd.randrange(len(t))] = rnd.choice(["Grubber,", "grubbest", "vilecho", "vileness"])
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    n = label.sum()
    return (rank[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


def test_held_out_accuracy(spark, make_docs):
    rows, labels = corpus()
    model = train(make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = {r.doc_id: (r.score, r.held) for r in
           add_score(make_docs(rows), model).withColumn("held", fold(F.col("doc_id")) == 1).collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, (_, h) in out.items())
    held = [(out[d][0], t) for d, _, t in labels if out[d][1]]
    assert auc(np.array([s for s, _ in held]), np.array([t for _, t in held])) > 0.97


def test_pairs_beyond_additive_weights():
    """Two terms that count only together: xor-like labels, which no linear
    score separates."""
    rnd = random.Random(1)
    texts, y = [], []
    for _ in range(1500):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        texts.append(" ".join(["qa"] * a + ["qb"] * b + [f"z{rnd.randint(0, 20)}"]))
        y.append(float(a and b))
    doc, bucket = terms(pa.array(texts))
    model = fit(doc, bucket, np.array(y))
    score = model.score(pa.array(["qa x", "qb x", "qa qb", "none"]))
    assert score[2] > 0.9 and max(score[0], score[1], score[3]) < 0.1
    i, j = (model.index[terms(pa.array([w]))[1][0]] for w in ("qa", "qb"))
    assert float(model.factors[i] @ model.factors[j]) != 0


def test_score_is_the_pairwise_sum():
    rng = np.random.default_rng(0)
    index = np.full(1 << 18, -1, dtype=np.int32)
    doc, bucket = terms(pa.array(["a bb ccc dddd", "", None]))
    index[bucket] = np.arange(len(bucket))
    m = Model(0.25, index, rng.normal(size=len(bucket)), rng.normal(size=(len(bucket), 3)))
    g = m.factors @ m.factors.T
    want = 0.25 + m.weight.sum() + (g.sum() - np.trace(g)) / 2
    assert np.allclose(m.raw(doc, bucket, 3), [want, 0.25, 0.25])


def test_edge_rows(spark, make_docs):
    rows = [(1, None), (2, ""), (None, "x"), (3, "x y"), (3, "x y"), (4, "long " * 200_000)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(2, 1, 0), (None, 1, 1), (3, None, None), (99, 1, 1)],
                                "doc_id long, quality int, toxic int")
    for labels in (none, one):
        model = train(make_docs(rows), labels)
        out = add_score(make_docs(rows).selectExpr("*", "'k' as label", "5 as score"), model)
        got = out.collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and got[0].label == "k"
    assert add_score(make_docs(rows).limit(0), model).count() == 0


def test_query_columns(spark):
    out = QUERIES["op9_toxicity"][0](spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert out.where("predicted != cast(score >= 0.7 as int)").count() == 0
