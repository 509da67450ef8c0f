import random

from pyspark.sql import functions as F

from routewise.llm import minhash as mh
from .conftest import make_docs, random_words


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, k):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", lower(t)) if x]
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k=4, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(group) if sets[i] and group else d))
    return sorted(out, key=str)


def check(spark, texts, ids=None):
    docs = make_docs(spark, texts, ids=ids)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in mh.report(docs).collect()), key=str)
    assert got == brute(list(zip(ids or range(len(texts)), texts)))


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = "new%d" % r.randrange(10**6)
    return out


def test_families_chains_and_odd_rows(spark):
    r = random.Random(5)
    texts = [None, "", " \n", "one two", "ONE  two", "one two three", "a b c d", "a b c d", "x" * 100_000]
    for f in range(4):
        base = random_words(100 + f, r.randint(40, 400), 500)
        texts += [" ".join(edited(r, base, r.randint(0, 6))) for _ in range(10)]
        chain = base
        for _ in range(8):  # each is close to the one before, not to the first
            chain = edited(r, chain, max(1, len(chain) // 50))
            texts.append(" ".join(chain))
    r.shuffle(texts)
    check(spark, texts)
    ids = [None if k % 7 == 0 else k // 2 * 3 for k in range(40)]
    assert mh.report(make_docs(spark, texts[:20] * 2, ids=ids)).count() == 40


def test_a_cluster_of_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(mh, "TILE_NODES", 15)
    monkeypatch.setattr(mh, "FEW", 3)
    r = random.Random(6)
    base = random_words(7, 120, 1000)
    texts = [" ".join(edited(r, base, r.randint(1, 9))) for _ in range(60)]
    check(spark, texts + ["z " + t for t in texts[:5]])


def test_shared_counts(monkeypatch):
    import numpy as np
    r = np.random.default_rng(2)
    for few in (1, 2, 16):
        monkeypatch.setattr(mh, "FEW", few)
        sets = [np.unique(r.integers(0, 60, r.integers(1, 30))).astype(np.uint64) for _ in range(25)]
        got = mh.shared_counts(np.concatenate(sets), np.array([len(s) for s in sets]))
        want = [[0 if i == j else len(np.intersect1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
        np.fill_diagonal(got, 0)
        assert got.tolist() == want


def test_given_documents(spark, corpus):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in mh.report(corpus).collect()), key=str)
    assert got == brute(rows)


def test_pipeline_form_and_empty_table(spark):
    docs = make_docs(spark, ["a b c d e f", "a b c d e f", "A B c d e f", "z", None, ""]).withColumn("NID", F.lit(1)) \
        .withColumn("node", F.lit("n")).withColumn("bands", F.lit(2))
    out = mh.keep_first(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 3, 4, 5]
    assert mh.report(make_docs(spark, [])).count() == 0


def test_keep_first_keeps_one_row_of_each_group(spark):
    a, b = "a b c d e f g h i j", "A b c d e f g h i j k"
    texts = [a, a, b, a, a, a, "other words are these here", "other words are these here", None, None, "", ""]
    ids = [1, 1, 1, None, None, 5, None, None, 7, 7, None, None]
    docs = make_docs(spark, texts, ids=ids).withColumn("h", F.lit(3)).withColumn("REPEATS", F.rand(1))
    out = mh.keep_first(docs, words=5, percent=60).collect()
    assert [r.doc_id for r in out if r.text in (a, b)] == [1]
    assert [r.doc_id for r in out if r.text and r.text.startswith("other")] == [None]
    assert len([r for r in out if not r.text]) == 4 and len(out) == 6
    everything_null = spark.createDataFrame([(None,) * 5] * 3, docs.schema[:5])
    assert mh.keep_first(everything_null).count() == 3
    assert mh.keep_first(make_docs(spark, [])).count() == 0


def family(n, seed=8):
    r = random.Random(seed)
    base = random_words(9, 200, 2000)
    return [" ".join(edited(r, base, r.randint(1, 3))) for _ in range(n)]


def test_a_family_has_few_candidate_edges(spark):
    docs = make_docs(spark, family(600))
    nodes = mh.describe(docs).withColumn("nid", F.monotonically_increasing_id())
    edges = mh.candidate_edges(nodes).cache()
    firsts = nodes.select("nid", F.explode("bands").alias("k")).groupBy("k").agg(F.min("nid").alias("f"), F.count("*").alias("n")) \
        .where("n > 1").select("f").distinct().count()
    assert 599 <= edges.count() <= 599 + firsts
    assert mh.components(edges).select("comp").distinct().count() == 1


def test_confirmed_stars_leave_little_to_tiles(spark, monkeypatch):
    """Only nodes of clusters that the stars left in several parts are dealt."""
    monkeypatch.setattr(mh, "TILE_NODES", 20)
    dealt = []
    plain = mh._with_sets
    monkeypatch.setattr(mh, "_with_sets", lambda docs, rows, keep, words: dealt.append(rows.count()) or plain(
        docs, rows, keep, words))
    texts = family(90)
    check(spark, texts)
    assert 90 <= dealt[0] <= 90 * 2 and dealt[1] < 90 * 5


def test_large_parts_meet_small_ones(spark, monkeypatch):
    """Several tiles of one part against shared tiles, with exchanged texts."""
    monkeypatch.setattr(mh, "TILE_NODES", 8)
    monkeypatch.setattr(mh, "FEW_ROWS", 0)
    r = random.Random(12)
    base = random_words(13, 150, 3000)
    other = edited(r, base, 9)
    texts = [" ".join(edited(r, base, r.randint(0, 2))) for _ in range(40)]
    texts += [" ".join(edited(r, other, r.randint(0, 2))) for _ in range(30)]
    texts += [" ".join(edited(r, base, r.randint(5, 9))) for _ in range(30)]
    r.shuffle(texts)
    check(spark, texts)


def test_signature_agreement_estimates_similarity():
    import numpy as np
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 1500, dtype=np.uint64)
    a, b = np.sort(pool[:1000]), np.sort(pool[250:1250])  # similarity 0.6
    s = mh.signatures(np.concatenate([a, b]), np.array([1000, 1000]), 2048)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.05
