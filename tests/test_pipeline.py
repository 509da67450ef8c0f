"""Pipeline-level checks at sf0.001: FIXTURES expected numbers, leakage
invariant, oracle agreement for a sample of registered queries, sinks."""

import os

import pytest
from pyspark.sql import functions as F

from routewise.plans import sellers
from routewise.plans.prepare import build_master, engineer_features
from routewise.sources import MissingInputError, fixture_tables, load_raw_tables, write_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def feat(spark):
    return engineer_features(build_master(fixture_tables(spark, SF)), []).cache()


def test_fixture_expected_numbers(feat):
    r = feat.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("order_id").alias("orders"),
                 F.sum("satisfied").alias("sat"), F.sum("is_late").alias("late"),
                 F.count(F.when(F.col("distance_km").isNull(), 1)).alias("null_dist"),
                 F.sum("same_state").alias("same")).first()
    assert (r.rows, r.orders, r.sat, r.late, r.null_dist, r.same) == (492, 477, 388, 62, 61, 90)
    bands = {x["distance_band"]: x["count"] for x in feat.groupBy("distance_band").count().collect()}
    assert bands == {"<100km": 21, "100-500km": 223, "500-1000km": 173, ">1000km": 13, None: 62}


def test_split_sizes_and_leakage(spark, feat):
    from routewise.operators.split import chronological_split
    lab = chronological_split(feat)
    train = lab.filter("is_train = 1").drop("is_train")
    test = lab.filter("is_train = 0").drop("is_train")
    assert (train.count(), test.count()) == (393, 99)
    before = sorted(sellers.seller_stats(train).collect())
    # altering the test part must not change any train-derived statistic
    altered = test.withColumn("review_score", F.lit(1)).withColumn("is_late", F.lit(1))
    tr1, _ = sellers.add_seller_features(train, test)
    tr2, _ = sellers.add_seller_features(train, altered)
    assert sorted(sellers.seller_stats(train).collect()) == before
    cols = ["order_id", "review_score", *sellers.SELLER_FEATURES]
    assert sorted(tr1.select(cols).collect()) == sorted(tr2.select(cols).collect())


@pytest.mark.parametrize("name", [
    "q_master", "q_corridor", "q_time_split", "q_mann_whitney", "q_spearman", "q_seller_features_test",
    "q_segment_profile", "q_recommendations_given", "q_roc_curve", "q_auc", "q_knn", "q_silhouette",
])
def test_oracle_agreement(spark, name):
    from routewise.plans.queries import ORACLE, QUERIES
    from tests.oracle_check import compare, duck
    r = compare(spark, duck(SF), name, QUERIES[name], ORACLE[name], SF)
    assert r["ok"], r


def test_missing_input_fails_with_table_name(spark, tmp_path):
    with pytest.raises(MissingInputError, match="orders"):
        load_raw_tables(spark, str(tmp_path))


def test_csv_round_trip_with_extra_columns(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", "delivered", "2018-01-01 10:00:00", None, None,
                                 "2018-01-05 10:00:00", "2018-01-20 00:00:00", "junk")],
                               "order_id string, customer_id string, order_status string, "
                               "order_purchase_timestamp string, order_approved_at string, "
                               "order_delivered_carrier_date string, order_delivered_customer_date string, "
                               "order_estimated_delivery_date string, extra string")
    path = os.path.join(tmp_path, "orders")
    write_table(df, path, fmt="csv")
    from routewise.sources.raw import read_csv_table
    back = read_csv_table(spark, path, "orders").first()
    assert back.order_status == "delivered" and back.order_delivered_customer_date.day == 5


def test_end_to_end_jobs_write_all_outputs(spark, tmp_path):
    from routewise.plans import pipeline, prediction as pr
    out = str(tmp_path / "run")
    pipeline.run_all(fixture_tables(spark, SF), out, grid=pr.QUICK_GRID, n_iter=2, n_folds=2, n_repeats=2)
    for name in ["master_olist_data", "train_data", "test_data", "geolocation_lookup"]:
        assert spark.read.parquet(f"{out}/prepared/{name}").count() > 0
    master = spark.read.parquet(f"{out}/prepared/master_olist_data")
    assert master.count() == 492 and len(master.columns) == 48
    read = lambda n: spark.read.option("header", True).csv(f"{out}/results/{n}")
    assert read("model_comparison").count() == 2
    assert read("feature_importance").count() == 25
    assert read("statistical_tests").count() == 2
    assert read("seller_recommendations").count() >= 3
    assert read("feature_importance_top15").count() == 15
    assert read("classification_report").count() == 10 and read("confusion_matrix").count() == 8
    assert read("split_summary").count() == read("distance_coverage").count() == 1
    assert read("cold_start_sellers").count() == 1
    assert read("roc_curve").select("model").distinct().count() == 2
    assert read("corridor_bubbles").count() == read("corridor_analysis").count()


def test_split_is_written_as_columns(spark):
    """Later scans of the split read only the columns they need."""
    import io
    from contextlib import redirect_stdout
    from routewise.plans.queries import _train_test
    train, _ = _train_test(spark, SF)
    text = io.StringIO()
    with redirect_stdout(text):
        train.select("delivery_delay_days", "satisfied").explain("formatted")
    scans = [line for line in text.getvalue().splitlines() if line.startswith("ReadSchema")]
    assert scans and all("delivery_delay_days" in s or "purchase" in s for s in scans)
    assert not any("seller_zip" in s or "distance_km" in s for s in scans)


def test_prepared_csv_round_trip_keeps_types(spark, tmp_path, feat):
    from routewise.sources import read_prepared
    out = str(tmp_path / "master_csv")
    write_table(feat, out, fmt="csv")
    back = read_prepared(spark, out, fmt="csv", id_type="bigint")
    want = {f.name: f.dataType.simpleString() for f in feat.schema.fields}
    got = {f.name: f.dataType.simpleString() for f in back.schema.fields}
    assert got == want
    cols = ["order_id", "review_score", "order_purchase_timestamp", "distance_km", "corridor", "satisfied"]
    assert sorted(back.select(cols).collect()) == sorted(feat.select(cols).collect())
