"""Cases off the fixture: very large ties, missing times, other session zones,
perfect orders, single classes."""

import math

import pytest
from pyspark.sql import functions as F

from routewise.operators.evaluate import auc, roc_curve
from routewise.operators.smote import smote
from routewise.operators.split import chronological_split
from routewise.operators.stats import (mann_whitney, mann_whitney_p, rank_sum_u, spearman,
                                       t_two_sided_p)


def test_mann_whitney_with_millions_of_equal_values(spark):
    n = 2_200_000
    df = spark.range(n).select((F.col("id") % 2).cast("int").alias("g"), F.lit(5).alias("v"))
    row = mann_whitney(df, "v", "g").first()
    assert row.u_stat == (n / 2) ** 2 / 2 and row.r_rb == 0
    assert math.isclose(rank_sum_u(df, "v", "g").first().tie_term, float(n) ** 3 - n, rel_tol=1e-12)


def labels(spark, rows, frac, schema="t timestamp_ntz, k int"):
    df = spark.createDataFrame(rows, "t string, k int").select(F.to_timestamp_ntz("t").alias("t"), "k")
    out = chronological_split(df, "t", ("k",), frac)
    return sorted(r.k for r in out.collect() if r.is_train == 1), out.count()


def test_split_boundary_among_missing_times(spark):
    rows = [(f"2020-01-0{k + 1} 00:00:00" if k < 5 else None, k) for k in range(10)]
    assert labels(spark, rows, 0.8) == ([0, 1, 2, 3, 4, 5, 6, 7], 10)
    assert labels(spark, [(None, k) for k in range(10)], 0.3) == ([0, 1, 2], 10)
    assert labels(spark, rows, 0.3) == ([0, 1, 2], 10)


def test_split_does_not_depend_on_the_session_zone(spark):
    rows = [(f"2017-10-15 0{k // 4}:{k % 4}0:00", k) for k in range(10)]  # clocks change at midnight there
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("America/Sao_Paulo", "UTC", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert labels(spark, rows, 0.3) == ([0, 1, 2], 10), zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("sign", [1, -1])
def test_spearman_of_a_perfect_order(spark, sign):
    df = spark.range(20).select(F.col("id").cast("double").alias("x"), (F.col("id") * sign).alias("y"))
    row = spearman(df, "x", "y").first()
    assert row.rho == sign and row.t_stat == sign * math.inf
    assert t_two_sided_p(row.t_stat, row.n - 2) == 0.0


def test_one_class(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.6)], "label int, score double")
    assert auc(df).first().auc is None
    assert {(r.tpr, r.fpr) for r in roc_curve(df).collect() if r.threshold < 1} <= {(0.5, None), (1.0, None)}
    with pytest.raises(ValueError, match="two classes"):
        smote(df.withColumn("id", F.col("score")), "id", ["score"], "label")


def test_smote_refuses_too_few_minority_rows(spark):
    df = spark.createDataFrame([(k, float(k), int(k < 3)) for k in range(20)], "id long, x double, y int")
    with pytest.raises(ValueError, match="lower k"):
        smote(df, "id", ["x"], "y", k=5)
    assert smote(df, "id", ["x"], "y", k=2).groupBy("y").count().select("count").distinct().count() == 1


def test_exact_or_asymptotic_is_the_callers_choice():
    assert mann_whitney_p(3, 3, 9, 1.7, 0.0) == mann_whitney_p(3, 3, 9, 1.7, 0.0, "exact") == 0.05
    assert math.isclose(mann_whitney_p(3, 3, 9, 1.7, 0.0, "asymptotic"), 0.0445654627585)
    with pytest.raises(ValueError):
        mann_whitney_p(3, 3, 9, 1.7, 6.0, "exact")


@pytest.mark.parametrize("t, dof, p", [
    (1.0, 1, 0.5), (0.0, 7, 1.0), (2.0, 2, 1 - 2 / math.sqrt(6)), (-3.0, 3, 0.0576688856),
    (1.959963985, 10_000_000, 0.05), (12.706204736, 1, 0.05), (40.0, 1000, None)])
def test_student_tail(t, dof, p):
    got = t_two_sided_p(t, dof)
    if p is None:  # far tail: small, but neither zero nor noise
        assert 0 < got < 1e-200
    else:
        assert math.isclose(got, p, rel_tol=1e-6)


def test_donors_are_one_permutation_for_each_repeat(spark):
    from routewise.plans.prediction import donors
    rows = donors(spark.range(500).withColumnRenamed("id", "k"), "k", 3, 42).collect()
    for r in range(3):
        pairs = [(p["_id"], p["_donor"]) for p in rows if p["_r"] == r]
        assert sorted(a for a, _ in pairs) == sorted(b for _, b in pairs) == list(range(500))
        assert sum(a == b for a, b in pairs) < 10
