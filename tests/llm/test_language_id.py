from collections import Counter
from statistics import median

import numpy as np
from pyspark.sql import functions as F

from routewise.llm import language_id as li
from .conftest import make_docs


def brute_model(docs):
    """text -> (language or None, score, known), learned like the module does from
    the same sampled texts, but by sets of tuples and one dense solve."""
    rows = docs.where(~li.held_out()).where("lang is not null").select(F.col("doc_id").alias("key"), "lang", "text")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    assert max(counts.values()) <= li.TRAIN  # all labelled texts are learned from
    train = [(r.lang, r.text) for r in rows.collect() if any(c.isalpha() for c in r.text or "")]
    marks = li._sample(rows.where(li.has_letter(F.col("text"))), "lang", ["key"], counts, li.LANDMARKS, 1)
    marks = sorted({(r.lang, r.text) for r in marks.collect()})
    letters = Counter(c for _, t in marks for c in t.lower() if c.isalpha())
    common = {c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:li.ALPHABET]}

    def sets(text):
        symbols = [" "]
        for c in text.lower() + " ":
            c = c if c in common else "other" if c.isalpha() else " "
            if c != " " or symbols[-1] != " ":
                symbols.append(c)
        return {tuple(symbols[i:i + n]) for n in li.ORDERS for i in range(len(symbols) - n + 1)}

    languages = sorted(counts)
    mark_sets = [sets(t) for _, t in marks]

    def kernel(text):
        own = sets(text)
        return [len(own & m) / (len(own) * len(m)) ** 0.5 for m in mark_sets]

    x = np.array([[*kernel(t), 1.0] for _, t in train])
    y = np.array([[float(lang == k) for k in languages] for lang, _ in train])
    penalty = np.zeros((len(marks) + 1,) * 2)
    penalty[:-1, :-1] = np.array([kernel(t) for _, t in marks]) + 1e-8 * np.eye(len(marks))
    weights = np.linalg.solve(x.T @ x + li.RIDGE * len(train) * penalty, x.T @ y)

    longest = [{g for g in s if len(g) == 3} for s in mark_sets]
    of = {k: [s for s, (lang, _) in zip(longest, marks) if lang == k] for k in languages}
    least = {k: li.LEAST_SHARE * median(sum(sum(g in other for other in of[k]) > 1 for g in s) / len(s)
                                        for s in of[k]) for k in languages}

    def judge(text):
        if not any(c.isalpha() for c in text or ""):
            return None, 0.0, False
        values = np.array([*kernel(text), 1.0]) @ weights
        own = {g for g in sets(text) if len(g) == 3}
        known = any(least[k] > 0 and sum(any(g in s for s in of[k]) for g in own) / len(own) >= least[k]
                    for k in languages) if own else False
        return languages[int(values.argmax())], min(1.0, max(0.0, values.max())), known
    return judge


def test_predictions_equal_an_independent_solve(spark, corpus):
    judge = brute_model(corpus)
    odd = make_docs(spark, [None, "", "12", "日本語です", "xq zzk wqx jjq", "the"], ids=[10_000 + k for k in range(6)])
    docs = corpus.select(odd.columns).unionByName(odd.withColumn("lang", F.lit(None).cast("string")))
    want = {r.doc_id: judge(r.text) for r in docs.collect()}
    got = {r.doc_id: r for r in li.report(docs).collect()}
    for i, (lang, score, _) in want.items():
        assert got[i].lang_pred == (lang or li.UNKNOWN) and abs(got[i].score - score) < 1e-3, i
    assert {r.doc_id for r in li.keep_known(docs).collect()} == {i for i, (_, _, known) in want.items() if known}


def test_kernel_is_the_normalised_number_of_shared_ngrams():
    texts = ["abc abd", "abd x", "zzz", "Ünï abc", "a", "12"]
    marks = li.Landmarks.of(texts, ["x"] * len(texts))

    def sets(t):
        symbols = [" "]
        for c in t.lower() + " ":
            s = c if c.isalpha() else " "
            if s != " " or symbols[-1] != " ":
                symbols.append(s)
        return {tuple(symbols[i:i + n]) for n in li.ORDERS for i in range(len(symbols) - n + 1)}

    got = marks.kernel(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            want = len(sets(a) & sets(b)) / (len(sets(a)) * len(sets(b))) ** 0.5
            assert abs(got[i, j] - want) < 1e-5, (a, b)


def test_held_out_accuracy(spark, corpus):
    got = li.report(corpus).join(corpus.select("doc_id", "lang"), "doc_id")
    assert got.count() == corpus.count()
    scored = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).head()[0]
    assert scored >= 0.95
    assert got.where("score < 0 or score > 1").count() == 0


def test_odd_texts_and_clashing_columns(spark, corpus):
    base = corpus.select("doc_id", "text", "lang", "source", "n_chars")
    long = base.where("lang = 'de'").orderBy("doc_id").head().text * 300
    odd = make_docs(spark, [None, "", "123 ... !", "日本語", long, long], [None, "en", "xx", None, None, None],
                    ids=[10_000 + k for k in range(5)] + [None]).withColumn("score", F.lit("s"))
    docs = base.withColumn("score", F.lit("s")).unionByName(odd)
    got = {r.doc_id: r for r in li.report(docs).collect()}
    assert [got[10_000 + k].lang_pred for k in range(3)] == ["und"] * 3
    assert all(got[10_000 + k].score == 0 for k in range(3))
    assert got[10_004].lang_pred == got[None].lang_pred == "de"
    kept = li.keep_known(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {r.doc_id for r in base.collect()} <= ids and not ids & {10_000, 10_001, 10_002}


def test_nothing_to_learn_or_predict(spark):
    assert li.keep_known(make_docs(spark, [])).count() == 0
    assert [r.text for r in li.keep_known(make_docs(spark, ["abc", "12"], [None, None])).collect()] == ["abc"]


def test_texts_of_unlearned_languages_go_and_short_clean_ones_stay(spark, corpus):
    base = corpus.select("doc_id", "text", "lang", "source", "n_chars")
    clean = [" ".join(r.text.split()[:8]) for r in base.where("lang is not null").orderBy("doc_id").limit(40).collect()]
    strange = ["これは日本語の文章です。今日は天気がいいですね。", "Сегодня хорошая погода, и мы идём гулять в парк.",
               "xqzjw kvbqx wzxkj qqvjx zkxwq jvqzk", "xq", "ж"]
    ids = [10_000 + k for k in range(len(clean) + len(strange))]
    docs = base.unionByName(make_docs(spark, clean + strange, [None] * len(ids), ids=ids))
    kept = {r.doc_id for r in li.keep_known(docs).collect()}
    assert not kept & set(ids[len(clean):])
    assert set(ids[:len(clean)]) <= kept and {r.doc_id for r in base.collect()} <= kept


def test_known_does_not_depend_on_the_number_of_languages():
    words = [["".join(chr(97 + (k * 7 + i * 3 + j) % 26) for j in range(4)) for i in range(6)] for k in range(20)]
    for n in (2, 20):
        texts = [" ".join(words[k]) for k in range(n) for _ in range(2)]
        marks = li.Landmarks.of(texts, [str(k) for k in range(n)])
        seen, least = li._seen_shares(marks, li.np.repeat(range(n), 2), n)
        model = li.Model(marks, li.np.zeros((2 * n + 1, n)), marks.languages, seen, least)
        assert model.known(words[0][0], 0) and not model.known("日本語 テキスト", 0)


def test_no_labels_outside_the_held_out_fold(spark):
    assert li.report(make_docs(spark, [])).count() == 0
    ids = spark.range(40).where(li.remainder(F.col("id"), li.FOLDS) == li.HELD_OUT).head(1)
    only_held = make_docs(spark, ["guten tag", "hello", "12"], ["de", None, None], ids=[ids[0][0], None, None])
    for docs in (only_held, make_docs(spark, ["abc", None], [None, None])):
        assert {(r.lang_pred, r.score) for r in li.report(docs).collect()} == {("und", 0.0)}
    assert {r.text for r in li.keep_known(only_held).collect()} == {"guten tag", "hello"}
