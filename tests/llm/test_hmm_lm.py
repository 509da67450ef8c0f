import math
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np

from routewise.llm import hmm_lm as lm
from .conftest import make_docs


def tokens(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [w.encode() for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + [None]


def fold(d, m):
    return zlib.crc32(b"" if d is None else str(d).encode()) % m


def base(rows):
    count = Counter(w for d, t in rows if fold(d, 7) != 2 for w in tokens(t))
    n, v = sum(count.values()), len(count)
    return {(d, t): (fold(d, 7) == 2, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n,
                     sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t))) for d, t in rows}


def check(spark, rows):
    docs = make_docs(spark, [t for _, t in rows], ids=[d for d, _ in rows])
    got = lm.report(docs).collect()
    want = base(rows)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(t)
    assert len(got) == len(rows)
    left = Counter((d, *want[d, t][:4]) for d, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == left
    for r in got:
        assert min(abs(r.base_score - want[r.doc_id, t][4]) for t in texts[r.doc_id]) < 1e-6
        assert r.score < 0 or not r.train_tokens
    return got


def test_base_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 60)
    rows = [(k, t) for k, t in enumerate([None, "", "One two ONE", "three x two", "a b c d e f" * 9, "\n\t"])]
    rows += [(k, f"word{k % 5} common É") for k in range(10, 40)] + [(None, "nobody"), (12, "word2 common É")]
    check(spark, rows)
    check(spark, [(1, "a b")] if fold(1, 7) == 2 else [(next(d for d in range(99) if fold(d, 7) == 2), "a b")])
    assert lm.report(make_docs(spark, [])).count() == 0


def test_better_than_the_base_on_held_out_texts(spark):
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in lm.report(corpus).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def small_model(monkeypatch, states=3, classes=5):
    monkeypatch.setattr(lm, "STATES", states)
    monkeypatch.setattr(lm, "CLASSES", classes)
    r = np.random.default_rng(3)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return lm.Model(norm(r.random(states), 0), norm(r.random((states, states)), 1),
                    norm(r.random((classes + 1, states)), 0))


def paths(m, seq):
    for path in product(range(len(m.start)), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for a, b, o in zip(path, path[1:], seq[1:]):
            p *= m.follow[a, b] * m.emit[o, b]
        yield path, p


def test_forward_and_counts_equal_the_sum_over_all_paths(monkeypatch):
    m = small_model(monkeypatch)
    seqs = [[0, 1, 5], [2], [3, 3, 4, 1, 5], [5], [1, 0]]
    flat, lengths = np.array(sum(seqs, [])), np.array([len(s) for s in seqs])
    want = [math.log10(sum(p for _, p in paths(m, s))) for s in seqs]
    assert np.allclose(lm.forward(m, flat, lengths), want)
    first, moves, emitted = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))
    for s in seqs:
        z = sum(p for _, p in paths(m, s))
        for path, p in paths(m, s):
            first[path[0]] += p / z
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / z
            for o, a in zip(s, path):
                emitted[o, a] += p / z
    got = lm.expected_counts(m, flat, lengths)
    assert all(np.allclose(g, w) for g, w in zip(got, (first, moves, emitted)))


def test_segments_change_no_count(monkeypatch):
    m = small_model(monkeypatch)
    r = np.random.default_rng(5)
    seqs = [np.append(r.integers(0, 5, n), 5) for n in (0, 1, 3, 4, 40, 7, 8, 2, 333, 3)]
    flat, lengths = np.concatenate(seqs), np.array([len(s) for s in seqs])
    monkeypatch.setattr(lm, "SEGMENT", 1000)
    whole = lm.expected_counts(m, flat, lengths)
    assert np.isclose(whole[0].sum(), len(seqs))
    assert np.isclose(whole[1].sum(), lengths.sum() - len(seqs)) and np.isclose(whole[2].sum(), lengths.sum())
    for segment in (1, 2, 3, 4, 50):
        monkeypatch.setattr(lm, "SEGMENT", segment)
        assert all(np.allclose(g, w) for g, w in zip(lm.expected_counts(m, flat, lengths), whole))


def test_segments_of_unlikely_classes(monkeypatch):
    m = small_model(monkeypatch)
    m.emit[1] = [1e-30, 2e-30, 1e-31]
    flat = np.array([1] * 700 + [5])
    monkeypatch.setattr(lm, "SEGMENT", 1000)
    whole = lm.expected_counts(m, flat, np.array([701]))
    monkeypatch.setattr(lm, "SEGMENT", 64)
    assert all(np.allclose(g, w) for g, w in zip(lm.expected_counts(m, flat, np.array([701])), whole))


def test_training_counts_starts_and_moves_of_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(lm, "SEGMENT", 4)
    seen = []
    keep = lm.Model.from_counts.__func__

    def from_counts(cls, starts, moves, emitted, share):
        seen.append((starts.sum(), moves.sum(), emitted.sum()))
        return keep(cls, starts, moves, emitted, share)

    monkeypatch.setattr(lm.Model, "from_counts", classmethod(from_counts))
    texts = ["one two three four five six seven", "", None, "a b c d", "x " * 50]
    docs = make_docs(spark, texts)
    _, tokens_of = lm.train(docs)
    n = sum(len(tokens(t)) for t in texts)
    assert tokens_of.sum() == n
    assert all(np.allclose(c, (len(texts), n - len(texts), n)) for c in seen) and len(seen) == lm.ITERATIONS


def test_a_model_is_a_probability(spark):
    share = np.full(lm.CLASSES + 1, 1 / (lm.CLASSES + 1))
    m = lm.Model.initial(share)
    assert np.allclose(m.emit.sum(axis=0), 1) and np.allclose(m.follow.sum(axis=1), 1)
