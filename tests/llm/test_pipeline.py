import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from routewise.llm import byte_bpe

from .conftest import SF
from .test_decontaminate import brute as contaminated
from .test_language_id import brute_model
from .test_line_dedup import key_of_line
from .test_minhash import brute as near


def test_stages_against_brute_force(spark, corpus):
    docs = [(r.doc_id, r.text) for r in corpus.orderBy("doc_id").collect()]
    judge = brute_model(corpus)
    docs = [d for d in docs if judge(d[1])[2]]

    first = {}
    for d, t in docs:
        for line in t.split("\n"):
            first.setdefault(key_of_line(line), d)
    docs = [(d, "\n".join(x for x in t.split("\n")
                          if len(key_of_line(x)) < 10 or first[key_of_line(x)] == d)) for d, t in docs]
    heads = {d for d, _, c in near(docs, k=5) if d == c}
    docs = [d for d in docs if d[0] in heads]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = contaminated(docs, items)
    docs = [d for d in docs if not hit[d[0]][1]]

    ranks = {p: i for i, p in enumerate(byte_bpe.read_ranks(
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {d: own.encode_ordinary(t) for d, t in docs}

    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: list(r.token_ids) for r in out} == want and len(out) == len(want)
    assert all(r.exact and r.n_tokens == len(r.token_ids) for r in out)


def test_stages_keep_the_columns(spark, corpus):
    docs = corpus.limit(40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.names == docs.schema.names, name
        empty = stage(spark, docs.limit(0), SF)
        assert empty.schema.names == docs.schema.names and empty.count() == 0


def test_stages_take_nulls_repeats_and_more_columns(spark, corpus):
    base = corpus.select("doc_id", "text", "lang", "source", "n_chars")
    text = base.where("lang = 'en'").orderBy("doc_id").head().text
    odd = spark.createDataFrame([(None,) * 5, (7, text, None, None, None), (7, text, None, None, None), (None, text, "en", "s", 1),
                                 (8, "", None, "s", 0)], base.schema)
    docs = base.unionByName(odd).withColumn("Known", F.lit(1)).withColumn("matches", F.lit("m")).withColumn("c0", F.lit(2))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.where(F.col("text") == text).count() <= 1
    done = corpus_pipeline.tokens(spark, docs, SF)
    assert done.count() == docs.count() and done.where("NOT exact").isEmpty()
