import random

import pytest

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents rows from (doc_id, text[, source]) tuples."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)
    return make


@pytest.fixture(scope="session")
def tangled():
    """Texts over few words with copied stretches, so repeats abound."""
    def make(seed, n=40, words=4, length=60):
        rnd, texts = random.Random(seed), []
        vocabulary = [f"w{i}" for i in range(words)]
        for _ in range(n):
            t = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, length))]
            for _ in range(rnd.randint(0, 3)):
                if texts:
                    other = rnd.choice(texts)
                    a = rnd.randint(0, len(other))
                    at = rnd.randint(0, len(t))
                    t[at:at] = other[a:a + rnd.randint(0, 40)]
            texts.append(t)
        return [rnd.choice([" ", "\n", " \t"]).join(t) for t in texts]
    return make
