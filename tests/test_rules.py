"""Rule-based segment naming, recommendations, radar normalisation and the
classification report on hand-made rows (expected values by hand)."""

from pyspark.sql import functions as F

from routewise.operators.evaluate import classification_report, confusion_matrix
from routewise.plans import sellers

SELLER_SCHEMA = ("seller_id long, segment int, order_count long, avg_review double, sat_rate double, "
                 "late_rate double, avg_distance double, avg_delivery_days double, avg_order_value double")


def _sellers(spark, rows):
    return spark.createDataFrame(rows, SELLER_SCHEMA)


def test_segment_names_rules_and_duplicate_suffix(spark):
    # one seller per segment, so segment means are the rows themselves
    rows = [
        (1, 0, 10, 4.8, 0.95, 0.02, 100.0, 5.0, 50.0),
        (2, 1, 50, 3.0, 0.50, 0.40, 900.0, 20.0, 80.0),
        (3, 2, 90, 4.0, 0.80, 0.10, 300.0, 9.0, 60.0),
        (4, 3, 60, 4.1, 0.82, 0.11, 350.0, 9.5, 65.0),
        (5, 4, 5, 3.9, 0.78, 0.12, 400.0, 10.0, 40.0),
    ]
    names = {r.segment: r.segment_name for r in sellers.segment_names(_sellers(spark, rows)).collect()}
    # linear quantiles of the 5 segment means: q70(review) = 4.08,
    # q30(late) = 0.102, q70(late) = 0.118, median(orders) = 50
    assert names == {0: "Top Performers",      # 4.8 >= 4.08 and 0.02 <= 0.102
                     1: "At-Risk",             # 0.40 >= 0.118
                     2: "High Volume",         # 90 >= 50
                     3: "High Volume (2)",     # 4.1 >= 4.08 but 0.11 > 0.102; 60 >= 50
                     4: "At-Risk (2)"}         # 0.12 >= 0.118


def test_recommendation_thresholds(spark):
    prof = spark.createDataFrame(
        [("A", 3, 0.85, 0.05), ("B", 2, 0.70, 0.20), ("C", 4, 0.60, 0.12), ("D", 1, 0.90, 0.12)],
        "segment_name string, n long, sat_rate double, late_rate double")
    rec = {r.Segment: r for r in sellers.recommendations(prof).collect()}
    # median sat_rate of [0.85, 0.70, 0.60, 0.90] = 0.775
    assert rec["A"].Strategy.startswith("Reward")
    assert rec["B"].Strategy.startswith("Improve")
    assert rec["C"].Strategy.startswith("Support")
    assert rec["D"].Strategy.startswith("Maintain")
    assert rec["A"].Satisfaction == "85.0%" and rec["B"].Late_Rate == "20.0%" and rec["C"].Sellers == 4


def test_radar_inverts_and_constant_column_is_null(spark):
    rows = [(1, 0, 10, 4.0, 0.8, 0.1, 100.0, 5.0, 1.0), (2, 1, 30, 5.0, 0.9, 0.3, 300.0, 5.0, 1.0)]
    named = _sellers(spark, rows).withColumn(
        "segment_name", F.when(F.col("segment") == 0, "x").otherwise("y"))
    radar = {r.segment_name: r for r in sellers.segment_radar(named).collect()}
    assert radar["x"].avg_review == 0.0 and radar["y"].avg_review == 1.0
    assert radar["x"].late_rate == 1.0 and radar["y"].late_rate == 0.0      # inverted
    assert radar["x"].avg_delivery_days is None                             # constant -> 0/0


def test_classification_report_and_confusion_by_hand(spark):
    # actual/predicted: tn=3, fp=1, fn=2, tp=4
    pairs = [(0, 0)] * 3 + [(0, 1)] + [(1, 0)] * 2 + [(1, 1)] * 4
    df = spark.createDataFrame(pairs, "label int, prediction int")
    cm = {(r.actual, r.predicted): r.n for r in confusion_matrix(df).collect()}
    assert cm == {(0, 0): 3, (0, 1): 1, (1, 0): 2, (1, 1): 4}
    rep = {r.class_label: r for r in classification_report(df).collect()}
    assert abs(rep["0"].precision - 3 / 5) < 1e-12 and abs(rep["0"].recall - 3 / 4) < 1e-12
    assert abs(rep["1"].precision - 4 / 5) < 1e-12 and abs(rep["1"].recall - 4 / 6) < 1e-12
    f0 = 2 * 0.6 * 0.75 / 1.35
    assert abs(rep["0"].f1_score - f0) < 1e-12 and rep["0"].support == 4
    assert abs(rep["accuracy"].f1_score - 0.7) < 1e-12 and rep["accuracy"].precision is None
    assert abs(rep["weighted avg"].recall - 0.7) < 1e-12


def test_permutation_importance_signal_beats_noise(spark):
    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from routewise.plans.prediction import permutation_importance, vectorize
    rnd = np.random.default_rng(3)
    a = rnd.normal(size=400)
    b = rnd.normal(size=400)
    y = (a + 0.3 * rnd.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame([(i, float(x), float(z), int(t)) for i, (x, z, t) in enumerate(zip(a, b, y))],
                               "rid long, a double, b double, satisfied int")
    model = LogisticRegression(featuresCol="features", labelCol="satisfied").fit(vectorize(df, ["a", "b"]))
    imp = {r.feature: r.permutation_importance for r in
           permutation_importance(model, df, ["a", "b"], "rid", n_repeats=3).collect()}
    assert imp["a"] > 0.2 and abs(imp["b"]) < 0.05


def test_the_search_runs_once_and_by_content(spark, monkeypatch):
    """The whole job on a tiny table: the same rows in another order are the same
    search, which is read and not run again."""
    import inspect

    import numpy as np
    from routewise.operators import boosting
    from routewise.plans import prediction as pr

    default = inspect.signature(pr.tune_boosted).parameters
    assert default["grid"].default is pr.REFERENCE_GRID
    assert (default["n_iter"].default, default["n_folds"].default) == (20, 5)
    r = np.random.default_rng(5)
    rows = [(float(a), float(b), int(a + b > 0)) for a, b in r.normal(size=(200, 2))]
    df = spark.createDataFrame(rows, "a double, b double, satisfied int")
    found, model = pr.tune_boosted(df, ["a", "b"], pr.QUICK_GRID, n_iter=3, n_folds=2)
    assert found.scores.count() == 6 and found.best in [*pr.sample_grid(pr.QUICK_GRID, 3, 42)]
    right = pr.predict(model, df, ["a", "b"], keep=("a",)).where("label = prediction").count()
    assert right > 180
    monkeypatch.setattr(boosting, "_grown", None)  # would fail if it ran
    again, _ = pr.tune_boosted(df.repartition(3), ["a", "b"], pr.QUICK_GRID, n_iter=3, n_folds=2)
    assert again.draw == found.draw and sorted(again.nodes.collect()) == sorted(found.nodes.collect())
