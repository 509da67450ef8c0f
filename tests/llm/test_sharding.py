import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from routewise.llm import sharding as sh
from .conftest import make_docs, random_words


def check(rows, texts, spread):
    assert len(rows) == len(texts)
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(load) <= set(range(24))
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    sizes = [load[k] for k in range(24)]
    assert max(sizes) - min(sizes) <= spread, sizes


def test_sizes_slots_and_digests(spark):
    texts = [" ".join(random_words(k, 20 + k % 90)) for k in range(3000)]
    rows = sh.report(make_docs(spark, texts)).collect()
    check(rows, texts, 2 * 24 * 100)
    for r in rows:
        b = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 8, zlib.crc32(b), "bytes", None)


def test_equal_texts_stay_together_unless_their_group_is_overfull(spark):
    texts = [f"text {k // 3} " + "x" * 50 for k in range(3000)] + ["one hot text " * 5] * 1500
    rows = sh.report(make_docs(spark, texts)).collect()
    check(rows, texts, 3000)
    shards = defaultdict(set)
    for r in rows:
        shards[texts[r.doc_id]].add(r.shard)
    assert len(shards["one hot text " * 5]) > 4
    assert sum(len(s) > 1 for t, s in shards.items() if t[0] == "t") <= 3  # of 1,000 groups


def test_repeated_rows_are_spread(spark):
    """One row 4,000 times, with its id, holds most of the bytes."""
    texts = ["the same row " + "x" * 8] * 4000 + [f"text {k} " * 2 for k in range(498)]
    ids = [1] * 4000 + list(range(2, 500))
    check(sh.report(make_docs(spark, texts, ids=ids)).collect(), texts, 1500)


def test_text_ids(spark):
    texts = [f"text {k % 7}" for k in range(500)]
    docs = make_docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") != 3, F.format_string("d%d", "doc_id")))
    rows = sh.report(docs).collect()
    check(rows, texts, 200)
    assert sum(r.doc_id is None for r in rows) == 1 and sum(r.doc_id == "d5" for r in rows) == 1


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(sh, "ROWS", 1)
    texts = [" ".join(random_words(k, 20)) for k in range(2000)]
    check(sh.report(make_docs(spark, texts)).collect(), texts, 400)


def test_odd_rows(spark):
    texts = [None, "", "é" * 70_000, "a", "a", "a"]
    docs = make_docs(spark, texts, ids=[1, None, None, 4, 4, 5]).withColumn("size", F.lit("s"))
    rows = sh.report(docs).collect()
    assert sorted(r.size for r in rows) == [8, 8, 9, 9, 9, 140_008]
    assert sorted(r.text_crc32 for r in rows)[:2] == [0, 0]
    assert sh.report(make_docs(spark, [])).count() == 0


def test_written_shards_and_plan(spark, tmp_path):
    docs = make_docs(spark, [f"text {k}" for k in range(100)])
    sh.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.select("shard").distinct().count() == 24
    plan = sh.report(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
