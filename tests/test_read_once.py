"""Queries that fit many models make their input once."""

import pytest
from pyspark.sql import functions as F

from routewise.operators.smote import smote
from routewise.plans import queries as q
from routewise.plans.sellers import SELLER_FEATURES


@pytest.mark.parametrize("name", ["q_kmeans", "q_kmeans_fixed_point"])
def test_seller_table_is_made_once(spark, monkeypatch, name):
    n, made = 40, spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        made.add(1)
        return v

    rows = [(i, 5 + i % 9, 1.0 + i % 5, 0.5, (i % 7) / 7, 100.0 + 13 * (i % 11), 5.0 + i % 6, 50.0 + i) for i in range(n)]
    cols = "seller_id long, order_count long, avg_review double, sat_rate double, late_rate double, " \
           "avg_distance double, avg_delivery_days double, avg_order_value double"
    table = spark.createDataFrame(rows, cols).withColumn("avg_order_value", counted("avg_order_value"))
    monkeypatch.setattr(q, "_seller_perf", lambda spark, sf: table)
    out = q.QUERIES[name](spark, "").collect()
    assert len(out) == (n if name == "q_kmeans" else 5)
    assert made.value <= 2 * n  # was made for each statistic


def test_model_features_are_made_once(spark, monkeypatch):
    feat = spark.range(60).select(
        F.col("id").alias("order_id"), (1 + F.col("id") % 5).alias("review_score"), (F.col("id") % 4).alias("seller_id"),
        F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(cast(id as int))").alias("order_purchase_timestamp"),
        (F.col("id") % 3 != 0).cast("int").alias("satisfied"), (F.col("id") % 2).alias("is_late"),
        *[(F.col("id") * (i + 1) % 17).cast("double").alias(c) for i, c in enumerate(
            c for c in q.pr.FEATURE_COLUMNS if c not in SELLER_FEATURES)])
    monkeypatch.setattr(q, "build_master", lambda tables: feat)
    monkeypatch.setattr(q, "_tables", lambda spark, sf: None)
    monkeypatch.setattr(q, "engineer_features", lambda master, top: master)
    tr, te, cols = q._model_data(spark, "")
    plan = tr._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # seller features were joined again in every pass
    assert tr.count() == 48 and te.count() == 12
    assert smote(tr, "row_id", cols, "satisfied", k=3).count() == 2 * tr.where("satisfied = 1").count()
