"""End-to-end jobs: preparation (master, train, test, geolocation lookup)
and analysis (corridor, tests, model comparison, importance, segments,
recommendations). Each heavy intermediate with several consumers is
written once to the shared checkpoint folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routewise.operators import cluster as cl
from routewise.operators import evaluate as ev
from routewise.operators.smote import smote
from routewise.operators.split import chronological_split, split_summary
from routewise.operators.orders import geo_lookup
from routewise.plans import corridors, eda, prediction as pr, sellers
from routewise.plans.prepare import build_master, engineer_features, top_category_names
from routewise.schemas import Tables
from routewise.session import cut_lineage, save_table
from routewise.sources import read_prepared, write_prepared, write_results


@dataclass
class Prepared:
    master: DataFrame
    train: DataFrame
    test: DataFrame
    geo: DataFrame
    summary: DataFrame


def prepare(tables: Tables, train_frac: float = 0.8) -> Prepared:
    """Clean, merge, engineer features (5 category dummies), split by time."""
    # the merged table is written once as Parquet for the 5 category names and the
    # split's histograms, the featured and labelled one for all analyses, which
    # then read the columns and the part they need
    base = save_table(build_master(tables))
    featured = engineer_features(base, top_category_names(base))
    labelled = save_table(chronological_split(featured, train_frac=train_frac, materialize=False)
                          .withColumn("is_train", F.col("is_train").cast("int")), "is_train")
    return Prepared(
        master=labelled.drop("is_train"),
        train=labelled.filter(F.col("is_train") == 1).drop("is_train"),
        test=labelled.filter(F.col("is_train") == 0).drop("is_train"),
        geo=geo_lookup(tables.geolocation),
        summary=split_summary(labelled))


def write_preparation(p: Prepared, out_dir: str, fmt: str = "parquet") -> None:
    write_prepared({"master_olist_data": p.master, "train_data": p.train, "test_data": p.test,
                    "geolocation_lookup": p.geo}, out_dir, fmt)


def corridor_analysis(master: DataFrame, min_orders: int = 50) -> dict[str, DataFrame]:
    # one row per corridor, read by four result tables
    corr = cut_lineage(corridors.corridor_stats(master, min_orders))
    return {"corridor_analysis": corr,
            "corridor_bubbles": corridors.corridor_bubbles(corr),
            "statistical_tests": corridors.statistical_tests(master, min_orders),
            "same_vs_cross": corridors.same_vs_cross(master),
            "state_satisfaction": corridors.state_satisfaction(master),
            "distance_trend": corridors.distance_trend(corr)}


def eda_tables(master: DataFrame) -> dict[str, DataFrame]:
    return {"review_distribution": eda.review_distribution(master),
            "class_balance": eda.satisfaction_rate(master),
            "delay_band": eda.delay_band_satisfaction(master),
            "correlation": eda.correlation_matrix(master)}


def run_prediction(train: DataFrame, test: DataFrame, grid: dict = pr.REFERENCE_GRID,
                   n_iter: int = 20, n_folds: int = 5, n_repeats: int = 10,
                   seed: int = 42) -> dict[str, DataFrame]:
    """Seller features, imputation, SMOTE, both models, comparison and
    importance (all statistics from ``train``)."""
    train = cut_lineage(train.withColumn("row_id", F.monotonically_increasing_id()))
    test = cut_lineage(test.withColumn("row_id", F.monotonically_increasing_id()))
    tr, te = sellers.add_seller_features(train, test)
    cols = pr.feature_columns(tr)
    keep = ["row_id", "order_id", "review_score"]
    tr, te, _ = pr.impute_medians(pr.as_features(tr, cols, keep), pr.as_features(te, cols, keep), cols)
    te = cut_lineage(te)
    oversampled = cut_lineage(smote(tr, "row_id", cols, pr.LABEL, k=5, seed=seed))
    lr, stats = pr.fit_logistic(oversampled, cols)
    found, gbt = pr.tune_boosted(oversampled, cols, grid, n_iter, n_folds, seed)
    scored = {"Logistic Regression": cut_lineage(pr.predict(lr, te, cols, stats)),
              "Gradient-Boosted Trees": cut_lineage(pr.predict(gbt, te, cols))}
    comparison = ev.comparison_table(_by_model(scored, lambda df, name: ev.model_metrics(df, name)))
    gain = gbt.gains().select(F.col("feature").alias("Feature"), F.col("gain_importance").alias("Gain_Importance"))
    perm = pr.permutation_importance(gbt, te, cols, "row_id", n_repeats, seed).select(
        F.col("feature").alias("Feature"), F.col("permutation_importance").alias("Permutation_Importance"))
    importance = gain.join(perm, "Feature", "left").orderBy(F.desc("Permutation_Importance"))
    named = lambda make: lambda df, name: make(df).withColumn("model", F.lit(name))
    return {"model_comparison": comparison, "feature_importance": importance,
            "feature_importance_top15": importance.limit(15),
            "classification_report": _by_model(scored, named(ev.classification_report)),
            "confusion_matrix": _by_model(scored, named(ev.confusion_matrix)),
            "roc_curve": _by_model(scored, named(ev.roc_curve)),
            "search_points": found.points, "search_scores": found.scores,
            "cold_start_sellers": sellers.cold_start(train, test)}


def _by_model(scored: dict[str, DataFrame], make) -> DataFrame:
    """The tables that ``make`` gives for each model, one below the other."""
    parts = [make(df, name) for name, df in scored.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run_seller_analysis(master: DataFrame, k_values=range(2, 7), n_init: int = 10,
                        final_n_init: int = 20, seed: int = 42) -> dict[str, DataFrame]:
    perf = cut_lineage(sellers.seller_performance(master))
    x = sellers.clustering_inputs(perf)
    stats = pr.scaler_stats(x, sellers.CLUSTER_COLUMNS)
    vec = cut_lineage(cl.assemble(pr.standardize(x, sellers.CLUSTER_COLUMNS, stats),
                                  sellers.CLUSTER_COLUMNS).select("seller_id", "features"))
    k, scores = cl.choose_k(vec, "seller_id", "features", k_values, n_init, seed)
    model, _ = cl.kmeans_restarts(vec, "features", k, final_n_init, seed)
    seg = model.transform(vec).select("seller_id", F.col("prediction").alias("segment"))
    labelled = cl.renumber_by(perf.join(seg, "seller_id"), "segment",
                              [("avg_review", True), ("late_rate", False)])
    named = sellers.name_sellers(labelled)
    profile = sellers.segment_profile(named)
    return {"seller_segments": profile,
            "seller_recommendations": sellers.recommendations(profile),
            "segment_radar": sellers.segment_radar(named),
            "seller_scatter": sellers.seller_scatter(named),
            "silhouette_by_k": master.sparkSession.createDataFrame(scores, "k int, silhouette double")}


def distance_coverage(master: DataFrame) -> DataFrame:
    """How many rows have a shipping distance."""
    return master.agg(F.count(F.lit(1)).alias("n_rows"), F.count("distance_km").alias("n_with_distance"),
                      F.avg(F.col("distance_km").isNotNull().cast("int")).alias("coverage"))


def run_analysis(spark: SparkSession, prepared_dir: str, out_dir: str, fmt: str = "parquet", **kw) -> None:
    """Every result table, from the prepared files alone."""
    master, train, test = (read_prepared(spark, f"{prepared_dir}/{name}", fmt)
                           for name in ("master_olist_data", "train_data", "test_data"))
    labelled = train.withColumn("is_train", F.lit(1)).unionByName(test.withColumn("is_train", F.lit(0)))
    results = {"split_summary": split_summary(labelled), "distance_coverage": distance_coverage(master)}
    results.update(eda_tables(master))
    results.update(corridor_analysis(master))
    results.update(run_prediction(train, test, **kw))
    results.update(run_seller_analysis(master))
    write_results(results, out_dir)


def run_all(tables: Tables, out_dir: str, **kw) -> None:
    """Both jobs: the prepared tables, then the analysis of those files."""
    write_preparation(prepare(tables), f"{out_dir}/prepared")
    spark = tables.orders.sparkSession
    run_analysis(spark, f"{out_dir}/prepared", f"{out_dir}/results", **kw)
