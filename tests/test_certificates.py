"""Certificates of fitted models, arithmetic draws, one-pass silhouettes."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from routewise.operators import cluster as cl
from routewise.operators import pairwise as pw
from routewise.operators.smote import draws_sql, smote, uniform_sql
from routewise.plans import prediction as pr


def points(spark, n=90, seed=2):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(c, 0.5, (n // 3, 2)) for c in ((0, 0), (4, 0), (0, 5))])
    x -= x.mean(axis=0)
    rows = [(k, *map(float, v)) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).select("id", "features"), x


def test_fixed_point_accepts_a_fit_and_rejects_other_centres(spark):
    df, x = points(spark)
    model, _ = cl.kmeans_restarts(df, "features", 3, n_init=3, tol=0.0)
    row = cl.fixed_point(df, "id", "features", model).head()
    assert (row.n, row.misplaced, row.cost_is_sum) == (90, 0, True)
    assert abs(row.total_ss - (x**2).sum()) < 1e-6
    early = KMeans(k=4, seed=1, featuresCol="features", maxIter=1, initMode="random").fit(df)
    late = cl.fixed_point(df, "id", "features", early).head()
    assert late.misplaced > 0 or not late.cost_is_sum


def test_logistic_moments_tell_an_optimum(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 2))
    y = (x[:, 0] + r.normal(size=300) > 0.7).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y)], "a double, b double, satisfied int")
    model, stats = pr.fit_logistic(df, ["a", "b"])
    rows = pr.logistic_moments(model, stats, df, ["a", "b"]).collect()
    assert [m.feature for m in rows] == ["(intercept)", "a", "b"]
    assert all(abs(m.observed - m.fitted) < 1e-6 for m in rows)

    class Off:
        intercept, coefficients = model.intercept, [float(c) + 0.01 for c in model.coefficients]

    assert any(abs(m.observed - m.fitted) > 1e-4 for m in pr.logistic_moments(Off, stats, df, ["a", "b"]).collect())


def test_uniform_draws(spark):
    d = spark.range(40_000).select(*[F.expr(uniform_sql("id", k, 42)).alias(f"u{k}") for k in (1, 2, 3)],
                                   F.expr(uniform_sql("id + 5000000000", 1, 42)).alias("far")).toPandas()
    for c in d:
        assert 0 <= d[c].min() and d[c].max() < 1
        counts = np.histogram(d[c], 50, (0, 1))[0]
        assert ((counts - 800) ** 2 / 800).sum() < 100  # 49 degrees of freedom
    assert abs(d.corr().to_numpy() - np.eye(4)).max() < 0.03
    assert abs(np.corrcoef(d.u1[1:], d.u1[:-1])[0, 1]) < 0.03


def test_synthetic_rows_are_the_drawn_ones(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(60, 2)).round(3)
    rows = [(k, float(a), float(b), int(k >= 15)) for k, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "rid long, a double, b double, y int")
    out = smote(df, "rid", ["a", "b"], "y", k=4, seed=7, order_col="rid").where("synthetic = 1").collect()
    draws = spark.range(30).select(*[F.expr(v).alias(k) for k, v in draws_sql("id", "15", 4, 7).items()]).collect()
    few, want = x[:15], []
    for d in draws:
        dist = np.sqrt(((few - few[d.position]) ** 2).sum(axis=1))
        dist[d.position] = np.inf
        near = few[np.lexsort((np.arange(15), dist))[d.neighbor_rank - 1]]
        want.append(tuple(few[d.position] + d.gap * (near - few[d.position])))
    assert np.allclose(sorted(want), sorted((m.a, m.b) for m in out))


def test_shifted_donors_are_permutations(spark):
    rows = spark.range(17)
    for r in range(3):
        got = pr.shifted_donors(rows, "id", 3, 42).where(F.col("_r") == r).collect()
        assert sorted(m._donor for m in got) == list(range(17)) and all(m._donor != m._id for m in got)


@pytest.mark.parametrize("tile_rows", [7, 2048])
def test_silhouettes_of_several_labellings_in_one_pass(spark, tile_rows):
    df, x = points(spark, 60)
    from pyspark.ml.functions import vector_to_array
    labels = {"p": [k % 3 for k in range(60)], "q": [k // 20 for k in range(60)], "r": [0] * 59 + [1]}
    names = spark.createDataFrame([(k, *(labels[c][k] for c in labels)) for k in range(60)], "id long, p int, q int, r int")
    got = {m.which: m.silhouette for m in pw.silhouette_scores(
        df.join(names, "id").withColumn("v", vector_to_array("features")), "id", "v", ["p", "q", "r"], tile_rows).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for which, lab in enumerate(labels.values()):
        lab, s = np.array(lab), []
        for i in range(60):
            own = (lab == lab[i]).sum()
            if own == 1:
                s.append(0.0)
                continue
            a = d[i, lab == lab[i]].sum() / (own - 1)
            b = min(d[i, lab == o].mean() for o in set(lab.tolist()) - {lab[i]})
            s.append((b - a) / max(a, b))
        assert abs(got[which] - np.mean(s)) < 1e-9
