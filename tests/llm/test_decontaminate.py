import hashlib
import re

from pyspark.sql import functions as F

from routewise.llm import decontaminate as dc
from .conftest import SF, make_docs, random_words

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(t):
    return WORD.findall((t or "").encode().lower())


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = tokens(text)
        if w and item is not None:
            for i in range(max(1, len(w) - size + 1)):
                windows.setdefault(tuple(w[i:i + size]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = {}
    for d, text in docs:
        w, hit, found = tokens(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i:i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[key]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def check(docs, bench, rows_d, rows_b):
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in dc.report(docs, bench).collect()}
    assert got == brute(rows_d, rows_b)


def test_random_phrases(spark, monkeypatch):
    items = [(f"i{k}", " ".join(random_words(1, 400, 8)[k * 7:k * 7 + n]))
             for k, n in enumerate([3, 12, 10, 1, 25, 11, 0, 9])] + [("i1", "x y"), (None, "a b c"), ("n", None)]
    docs = [" ".join(random_words(1, 400, 8)), " ".join(random_words(1, 60, 8)), None, "", "...",
            " ".join(random_words(2, 5000, 8)), "X, y", "X, y"]
    bench = spark.createDataFrame(items, "item_id string, text string")
    df = make_docs(spark, docs)
    check(df, bench, list(enumerate(docs)), items)
    monkeypatch.setattr(dc, "GROUP_BYTES", 40)  # many groups of items
    check(df, bench, list(enumerate(docs)), items)
    monkeypatch.setattr(dc, "GROUP_BYTES", 8 << 20)
    monkeypatch.setattr(dc, "SLICE_BYTES", 300)  # several slices of the index
    monkeypatch.setattr(dc, "BATCH_WINDOWS", 4)
    monkeypatch.setattr(dc, "PLACES", 16)
    check(df, bench, list(enumerate(docs)), items)


def test_the_index_holds_every_position_of_every_term(spark, monkeypatch):
    monkeypatch.setattr(dc, "SLICE_BYTES", 40)
    docs = make_docs(spark, ["One two three two", "two; THREE", None, "", "é one", "four five six seven eight nine"])
    index = dc.build_index(docs)
    terms = index.sparkSession.createDataFrame(
        [(bytearray(w.encode()),) for w in ("one", "two", "é", "nine", "ten")], "term binary")
    assert sum(len(r.gaps) for r in dc.postings(index, terms).collect()) == 2 + 3 + 1 + 1
    assert index.select("slice").distinct().count() > 1


def test_bytes_that_are_no_text(spark):
    docs = make_docs(spark, ["seen once", "x"]).withColumn("text", F.expr(
        "case when doc_id = 0 then cast(unhex('61FF2062206320FE') as string) else text end"))
    bench = spark.range(1).selectExpr("'i' as item_id", "cast(unhex('61FF2062') as string) as text")
    assert [r.doc_id for r in dc.decontaminate(docs, bench).collect()] == [1]


def test_given_tables(spark, corpus):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    check(corpus, bench, [(r.doc_id, r.text) for r in corpus.collect()],
          [(str(r.item_id), r.text) for r in bench.collect()])


def test_empty_and_filter(spark):
    bench = spark.createDataFrame([], "item_id string, text string")
    docs = make_docs(spark, ["one two three", None]).withColumn("matches", F.lit(1))
    assert [r.n_hit for r in dc.report(docs, bench).collect()] == [0, 0]
    assert dc.report(make_docs(spark, []), bench).count() == 0
    bench = spark.createDataFrame([("a", "two three")], "item_id string, text string")
    kept = dc.decontaminate(docs, bench)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def test_proximity(spark):
    bench = spark.createDataFrame([("a", "alpha beta gamma")], "item_id string, text string")
    docs = make_docs(spark, ["alpha x beta gamma", "alpha beta gamma", "alpha x x x x beta gamma", "gamma"])
    got = {r.doc_id: [(m.start, m.exact) for m in r.matches]
           for r in dc.find_matches(docs, bench, slack=1).collect()}
    assert [e for _, e in got[0]] and not any(e for _, e in got[0])
    assert any(e for _, e in got[1]) and not got[2] and not got[3]
