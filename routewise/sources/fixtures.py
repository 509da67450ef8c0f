"""Commerce-shaped views over the driver's TPC-H-like parquet tables.

The driver tables have no reviews, payments, delivery dates or
coordinates, so they are derived by integer arithmetic on the keys (the
recipe of FIXTURES.md §5). The same text, as SQL CTEs, feeds the DuckDB
oracle (``routewise.plans.oracle``). The recipe deliberately plants nulls,
duplicates and unmatched keys so every join and null rule is exercised.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routewise.schemas import Tables


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _plus_seconds(seconds: Column, ts: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("int"), ts)


def fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    k = F.col("o_orderkey")
    day_sec = (k * 7919) % 86400
    orders_src = _read(spark, sf_dir, "orders")

    orders = orders_src.select(
        k.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.when(F.col("o_orderstatus") == "F", "delivered")
        .when(F.col("o_orderstatus") == "O", "shipped")
        .otherwise("canceled").alias("order_status"),
        _plus_seconds(day_sec, F.col("o_orderdate")).alias("order_purchase_timestamp"),
        _plus_seconds(day_sec + 3600, F.col("o_orderdate")).alias("order_approved_at"),
        F.when(k % 83 == 0, None).otherwise(
            _plus_seconds(day_sec + 86400 * (1 + k % 4), F.col("o_orderdate"))
        ).alias("order_delivered_carrier_date"),
        F.when(k % 97 == 0, None).otherwise(
            _plus_seconds(day_sec + 3600 * (48 + (k * 13) % 700), F.col("o_orderdate"))
        ).alias("order_delivered_customer_date"),
        F.when(k % 89 == 0, None).otherwise(
            _plus_seconds(day_sec + 86400 * (20 + k % 17), F.col("o_orderdate"))
        ).alias("order_estimated_delivery_date"),
    )

    first_review = orders_src.filter(k % 50 != 7).select(
        k.alias("order_id"),
        F.when(48 + (k * 13) % 700 > 24 * (20 + k % 17), 1 + (k * 31) % 4)
        .when((k * 31) % 10 < 1, F.lit(3).cast("bigint"))
        .otherwise(4 + k % 2).alias("review_score"),
    )
    second_review = orders_src.filter(k % 40 == 0).select(
        k.alias("order_id"), (1 + (k * 31) % 5).alias("review_score"))
    reviews = first_review.unionByName(second_review)

    li = _read(spark, sf_dir, "lineitem")
    zero = F.col("l_orderkey") % 113 == 0
    items = li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.when(zero, F.lit(0.0)).otherwise(F.col("l_extendedprice")).alias("price"),
        F.when(zero, F.lit(0.0)).otherwise(F.col("l_extendedprice") * F.col("l_tax"))
        .alias("freight_value"),
    )

    # 1..(1 + key % 3) payment lines per order, none when key % 71 = 0
    s = F.col("payment_sequential")
    payments = (
        orders_src.filter(k % 71 != 0)
        .select(k.alias("order_id"),
                F.explode(F.sequence(F.lit(1).cast("bigint"), 1 + k % 3)).alias("payment_sequential"))
        .select(
            "order_id", s.cast("int").alias("payment_sequential"),
            F.when((F.col("order_id") + s) % 4 == 0, "credit_card")
            .when((F.col("order_id") + s) % 4 == 1, "boleto")
            .when((F.col("order_id") + s) % 4 == 2, "debit_card")
            .otherwise("voucher").alias("payment_type"),
            (1 + (F.col("order_id") + 3 * s) % 10).alias("payment_installments"),
        )
    )

    part = _read(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    products = part.select(
        pk.alias("product_id"),
        F.when(pk % 29 == 0, None).otherwise(F.lower("p_type")).alias("product_category_name"),
        F.when(pk % 31 == 0, None).otherwise(F.col("p_size") * F.lit(100.0)).alias("product_weight_g"),
    )
    categories = (part.filter(F.col("p_type") != "PROMO")
                  .select(F.lower("p_type").alias("product_category_name"))
                  .distinct()
                  .select("product_category_name",
                          F.concat(F.lit("cat "), F.col("product_category_name"))
                          .alias("product_category_name_english")))

    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = _read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo_of_nation = nation.join(region, nation.n_regionkey == region.r_regionkey)

    cust = _read(spark, sf_dir, "customer")
    customers = (cust.join(geo_of_nation, cust.c_nationkey == geo_of_nation.n_nationkey)
                 .select(F.col("c_custkey").alias("customer_id"),
                         F.col("r_name").alias("customer_state"),
                         (F.col("c_nationkey") * 10 + F.col("c_custkey") % 10)
                         .alias("customer_zip_code_prefix")))

    supp = _read(spark, sf_dir, "supplier")
    sellers = (supp.filter(F.col("s_suppkey") % 53 != 5)
               .join(geo_of_nation, supp.s_nationkey == geo_of_nation.n_nationkey)
               .select(F.col("s_suppkey").alias("seller_id"),
                       F.col("r_name").alias("seller_state"),
                       (F.col("s_nationkey") * 10 + F.col("s_suppkey") % 10)
                       .alias("seller_zip_code_prefix")))

    zips = (cust.select((F.col("c_nationkey") * 10 + F.col("c_custkey") % 10).alias("zip"),
                        F.col("c_custkey").alias("k"))
            .unionByName(supp.select((F.col("s_nationkey") * 10 + F.col("s_suppkey") % 10)
                                     .alias("zip"), F.col("s_suppkey").alias("k"))))
    z = F.col("zip")
    geolocation = zips.filter(z % 41 != 0).select(
        z.alias("geolocation_zip_code_prefix"),
        (F.lit(-25.0) + F.lit(1.5) * ((z % 50) / F.lit(10.0)) + F.lit(0.01) * (F.col("k") % 7))
        .alias("geolocation_lat"),
        (F.lit(-55.0) + F.lit(0.4) * (z % 25) + F.lit(0.01) * (F.col("k") % 5))
        .alias("geolocation_lng"),
    )

    return Tables(orders=orders, reviews=reviews, items=items, payments=payments,
                  products=products, categories=categories, customers=customers,
                  sellers=sellers, geolocation=geolocation)
