"""Oversampling inside the folds: no synthetic row looks at the fold left out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from routewise.operators import boosting as bo
from routewise.operators.smote import ALL_ROWS, REAL, smote_inside_folds
from routewise.plans import prediction as pr


def rows(n=160, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2)).round(3)
    return [(k, float(a), float(b), int(k % 4 != 0), (k // 4) % 3) for k, (a, b) in enumerate(x)]


def test_synthetic_rows_lie_between_near_rows_of_the_other_folds(spark):
    data = rows()
    df = spark.createDataFrame(data, "rid long, a double, b double, y int, fold int")
    out = smote_inside_folds(df, "rid", ["a", "b"], "y", "fold", 3, k=4).collect()
    assert sorted((m.a, m.b, m.y, m.fold) for m in out if m.for_fold == REAL) == sorted(d[1:] for d in data)
    for f in (ALL_ROWS, 0, 1, 2):
        few = np.array([d[1:3] for d in data if d[3] == 0 and d[4] != f])
        many = sum(d[3] == 1 and d[4] != f for d in data)
        new = [m for m in out if m.for_fold == f]
        assert len(new) == many - len(few) and all(m.y == 0 and m.fold is None for m in new)
        d = np.sqrt(((few[:, None] - few[None]) ** 2).sum(axis=2))
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1)[:, :4]
        for m in new:
            p = np.array([m.a, m.b])
            base, other = np.repeat(few, 4, axis=0), few[near.ravel()]
            gap = ((p - base) * (other - base)).sum(axis=1) / ((other - base) ** 2).sum(axis=1)
            off = np.abs(base + gap[:, None] * (other - base) - p).sum(axis=1)
            assert (off[(gap > -1e-9) & (gap < 1 + 1e-9)] < 1e-9).any()


def test_too_few_rows_raise(spark):
    df = spark.createDataFrame(rows(16), "rid long, a double, b double, y int, fold int")
    with pytest.raises(ValueError):
        smote_inside_folds(df, "rid", ["a", "b"], "y", "fold", 3, k=4)


def test_models_learn_from_their_own_synthetic_rows_only():
    fold = np.array([0, 1, 2, bo.ONLY_FOR - 1, bo.ONLY_FOR, bo.ONLY_FOR + 1])
    key = np.arange(6)
    point = {"subsample": 1.0}
    learned = [bo._learned(key, fold, bo.Candidate(0, f, point), 0, 42).tolist() for f in (-1, 0, 1)]
    assert learned == [[0, 1, 2, 3], [1, 2, 4], [0, 2, 5]]


def test_a_search_oversampled_inside(spark):
    df = spark.createDataFrame([(a, b, int(a + b > -0.9)) for _, a, b, _, _ in rows(240)], "a double, b double, satisfied int")
    found, model = pr.tune_boosted(df, ["a", "b"], pr.QUICK_GRID, n_iter=2, n_folds=2, oversample_inside=True)
    counted = found.scores.agg(F.max(F.col("tp") + F.col("fn"))).head()[0]
    assert counted <= df.where("satisfied = 1").count() // 2 + 1  # real rows only are scored
    assert pr.predict(model, df, ["a", "b"], keep=("a",)).where("label = prediction").count() > 200
