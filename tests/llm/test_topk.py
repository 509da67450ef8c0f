import math
import random

from routewise.llm import topk


def brute(rows, k=10):
    clean = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            clean.append((i, [math.floor(1024 * x) for x in v]))
    out = []
    for i, q in clean:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, w)), j) for j, w in clean if j != i and len(w) == len(q))
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.report(df).collect())
    assert got == brute(rows)


def test_rows_of_one_id_are_rows_of_their_own(spark, monkeypatch):
    run(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [9.0, 0.0])])
    run(spark, [(0, [1.0, 2.0]), (0, [3.0, 1.0]), (0, [1.0, 2.0]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (100, [2.0, 2.0])])
    monkeypatch.setattr(topk, "BLOCK", 50)
    run(spark, [(7, [1.0, 2.0, 3.0])] * 400 + [(100 * k, [float(k), 1.0, -1.0]) for k in range(9)])


def test_random_vectors_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 150)
    monkeypatch.setattr(topk, "CHUNK", 3)
    r = random.Random(1)
    run(spark, [(k, [r.gauss(0, 1) for _ in range(12)]) for k in range(1200)])


def test_skewed_values_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 400)
    r = random.Random(2)
    rows = [(k, [r.choice([0.0, 0.0, 1.0, -1.0]) for _ in range(6)]) for k in range(900)]
    run(spark, rows + rows[:50] + [(100, [9.0] * 6), (200, [0.0] * 6)])


def test_unusable_rows_lengths_and_large_values(spark):
    run(spark, [(0, [1.0, 2.0]), (100, None), (200, [1.0, None]), (300, [float("nan"), 1.0]),
                (400, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [1.0, 1.0, 1.0]), (2, [3.0, -4.0]),
                (500, []), (600, [1e6, -1e6]), (3, [2e6, 1e6]), (700, [5.0, 5.0, 5.0])])
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.report(empty).count() == 0
