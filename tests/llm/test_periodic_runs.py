import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from routewise.llm import periodic_runs as pr
from .conftest import make_docs


def brute_runs(words, min_length=24, min_periods=3):
    """Every period, every maximal stretch of equal words that far apart."""
    best = {}
    n = len(words)
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            if length >= max(min_length, min_periods * q):
                best.setdefault((s, length), q)
    return sorted((s, l, q) for (s, l), q in best.items())


def words_in(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def kept_words(words, runs):
    out = {i for s, l, q in runs for i in range(s + q, s + l)}
    return [w for i, w in enumerate(words) if i not in out]


def planted(doc_id, words):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_report(doc_id, text):
    words = planted(doc_id, words_in(text))
    runs = brute_runs(words)
    from fractions import Fraction
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            sha("".join(f"{s},{l},{q}\n" for s, l, q in runs)), sha(" ".join(kept_words(words, runs))))


def texts_with_runs(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(1, 4)):
            few = [r.choice("abAé") * r.randint(1, 2) for _ in range(r.randint(1, 5))]
            parts += [r.choice("abcdef") for _ in range(r.randint(0, 12))]
            parts += (few * 40)[:r.randint(1, 70)]
        out.append(r.choice([" ", "\n", " \t "]).join(parts))
    return out


@pytest.mark.parametrize("alphabet", [1, 2, 3, 8])
def test_runs_of_random_keys(alphabet):
    r = np.random.default_rng(alphabet)
    for n in (1, 2, 3, 10, 40, 120):
        for _ in range(15):
            keys = r.integers(0, alphabet, n).astype(np.uint64)
            if r.random() < 0.5:
                keys = np.tile(keys[:max(1, n // 7)], 9)[:n]
            mine = np.append(keys, np.uint64(99))
            for length, periods in ((2, 2), (6, 3), (24, 3)):
                got = list(zip(*(x.tolist() for x in pr.runs_of(mine, length, periods))))
                assert got == brute_runs(keys.tolist(), length, periods)


def test_few_asked_at_a_time(monkeypatch):
    monkeypatch.setattr(pr, "ASKED", 3)
    test_runs_of_random_keys(2)


def test_levels_and_prefixes():
    r = np.random.default_rng(3)
    keys = np.append(r.integers(0, 2, 60), 7).astype(np.uint64)
    order, levels = pr.rank_levels(keys)
    suffixes = [tuple(keys[i:].tolist()) for i in order]
    assert suffixes == sorted(suffixes)
    i, j = np.divmod(np.arange(61 * 61), 61)
    i, j = i[i < j], j[i < j]
    text = keys.tolist()

    def ahead(a, b):
        k = 0
        while b + k < 61 and text[a + k] == text[b + k]:
            k += 1
        return k

    def behind(a, b):
        k = 0
        while a - k > 0 and text[a - k - 1] == text[b - k - 1]:
            k += 1
        return k

    assert pr.common_prefixes(levels, i, j).tolist() == [ahead(a, b) for a, b in zip(i.tolist(), j.tolist())]
    assert pr.common_suffixes(levels, i, j).tolist() == [behind(a, b) for a, b in zip(i.tolist(), j.tolist())]


def test_find_runs_of_texts(spark, monkeypatch):
    monkeypatch.setattr(pr, "SLICE_BYTES", 700)
    texts = [None, "", " \n\t ", "a", "a " * 24, "a " * 23, "a b " * 12 + "a", "x" * 100_000, "ä ö " * 5000,
             ("one two three " * 9).upper(), "a a b " * 10 + "a A a"] + texts_with_runs(1, 40)
    docs = make_docs(spark, texts).withColumn("RUNS", F.lit(1)).withColumn("word", F.lit("x"))
    got = {r.doc_id: r for r in pr.find_runs(docs).collect()}
    for i, t in enumerate(texts):
        words = words_in(t)
        runs = brute_runs(words) if len(words) < 5000 else [(0, 10000, 2)]
        assert [tuple(x) for x in got[i].runs] == runs, (i, t)
        assert got[i].collapsed == " ".join(kept_words(words, runs)), (i, t)
    out = pr.find_runs(docs)
    assert [c.lower() for c in out.columns].count("runs") == 1 and "word" in out.columns


def test_report_plants_and_digests(spark):
    texts = [None, "", "  "] + texts_with_runs(2, 60) + [" ".join(str(k) for k in range(90))] * 60
    ids = [None if k % 11 == 5 else k // 2 for k in range(len(texts))]  # repeated and null ids
    got = sorted((tuple(r) for r in pr.report(make_docs(spark, texts, ids=ids)).collect()), key=str)
    assert got == sorted((brute_report(i, t) for i, t in zip(ids, texts)), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids if i is not None)
    assert pr.report(make_docs(spark, [])).count() == 0


def test_given_documents(spark, corpus):
    got = sorted(tuple(r) for r in pr.report(corpus.where("n_chars < 4000")).collect())
    want = sorted(brute_report(r.doc_id, r.text) for r in corpus.where("n_chars < 4000").collect())
    assert got == want


def test_two_periods_are_the_least(spark):
    with pytest.raises(ValueError):
        pr.find_runs(make_docs(spark, ["a a"]), min_periods=1)
