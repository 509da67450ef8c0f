import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])

SF = "/root/testdata/sf0.001"


def make_docs(spark, texts, langs=None, ids=None):
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", "s", None if t is None else len(t))
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def random_words(seed, n, vocabulary=30):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(vocabulary)]
    return [r.choice(pool) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
