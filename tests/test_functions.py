"""Scalar functions and per-order aggregates on hand-made rows (traps X2-X6, X10)."""

import datetime as dt
import math

from pyspark.sql import functions as F

from routewise.functions import days_between, distance_band, flag, haversine_km, safe_ratio
from routewise.operators.orders import order_items_summary, payment_profile


def test_haversine_null_guard_and_values(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0, 0.0, 1.0), (None, 0.0, 0.0, 1.0), (10.0, 20.0, 10.0, 20.0)],
        "a double, b double, c double, d double")
    out = [r[0] for r in df.select(haversine_km(*[F.col(c) for c in "abcd"])).collect()]
    assert math.isclose(out[0], 2 * 6371 * math.asin(math.sin(math.radians(0.5))), rel_tol=1e-12)
    assert out[1] is None  # a clamp outside the guard would give ~20,015 km
    assert out[2] == 0.0


def test_distance_band_right_closed_zero_and_null(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 50.0, 100.0, 100.5, 500.0, 1000.0, 1000.1, None]],
                               "x double")
    got = [r[0] for r in df.select(distance_band(F.col("x"))).collect()]
    assert got == [None, "<100km", "<100km", "100-500km", "100-500km", "500-1000km", ">1000km", None]


def test_flag_and_safe_ratio(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 0.0), (None, 1.0)], "a double, b double")
    rows = df.select(flag(F.col("a") > 0).alias("f"), safe_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r.f for r in rows] == [1, 0, 0]
    assert [r.r for r in rows] == [0.5, 0.0, 0.0]


def test_days_between_fractional(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2, 12))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert df.select(days_between(F.col("a"), F.col("b"))).first()[0] == 1.5


def test_first_seller_skips_null_but_first_product_keeps_it(spark):
    items = spark.createDataFrame(
        [(1, 1, None, None, 10.0, 1.0), (1, 2, 7, 99, 5.0, 0.5), (2, 1, 3, 4, 0.0, 0.0)],
        "order_id long, order_item_id int, product_id long, seller_id long, price double, freight_value double")
    rows = {r.order_id: r for r in order_items_summary(items).collect()}
    assert rows[1].seller_id == 99 and rows[1].product_id is None
    assert rows[1].num_items == 2 and rows[1].total_price == 15.0
    assert rows[2].freight_ratio == 0.0  # 0/0 -> 0


def test_payment_mode_tie_takes_smallest(spark):
    pays = spark.createDataFrame(
        [(1, "voucher", 1), (1, "boleto", 3), (1, "voucher", 2), (1, "boleto", 1), (2, "x", 1)],
        "order_id long, payment_type string, payment_installments int")
    rows = {r.order_id: r for r in payment_profile(pays).collect()}
    assert rows[1].primary_payment_type == "boleto" and rows[1].payment_installments == 3


def test_days_between_ignores_session_zone_dst_gap(spark):
    # 1995-10-15 00:41:58 does not exist in Sao Paulo local time (DST gap)
    df = spark.createDataFrame([(dt.datetime(1995, 9, 14, 0, 41, 58), dt.datetime(1995, 10, 15, 0, 41, 58))],
                               "a timestamp_ntz, b timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        assert df.select(days_between(F.col("a"), F.col("b"))).first()[0] == 31.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
