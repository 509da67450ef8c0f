"""Build the (order, review)-grain master table and its features.

Plan shape (one lazy plan, actions only at sinks and for the 5 category
names):

    items --agg(order_id)--> per-order summary --join(product_id)--> + category
    payments --agg(order_id)--> per-order payment profile
    geolocation --agg(zip)--> medians --join--> customers, sellers (dimension enrichment)
    delivered orders --join reviews (1:n) --join per-order tables (same key,
        shared hash partitioning) --join customers --join sellers --> master

Enriching the two small dimensions with coordinates *before* they meet
the fact rows replaces two wide-table joins on zip by narrow ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewise.functions import (
    days_between,
    distance_band,
    dummy_name,
    flag,
    haversine_km,
    weekday_monday0,
)
from routewise.operators.orders import (
    geo_lookup,
    order_items_summary,
    payment_profile,
    product_category,
    top_values,
)
from routewise.schemas import TIMESTAMP_COLUMNS, Tables

MASTER_BASE_COLUMNS = [
    "order_id", "customer_id", "order_status", *TIMESTAMP_COLUMNS, "review_score",
    "seller_id", "total_price", "total_freight", "num_items", "total_order_value",
    "freight_ratio", "payment_installments", "primary_payment_type",
    "product_category_name_english", "product_weight_g", "customer_state",
    "customer_zip_code_prefix", "seller_state", "seller_zip_code_prefix",
    "cust_lat", "cust_lng", "sell_lat", "sell_lng", "distance_km",
]

PAYMENT_TYPES = ["credit_card", "boleto", "debit_card"]
CATEGORY_PREFIX = "cat_"


def delivered_orders(orders: DataFrame) -> DataFrame:
    """Delivered orders that carry an actual delivery date."""
    return orders.filter((F.col("order_status") == "delivered")
                         & F.col("order_delivered_customer_date").isNotNull())


def order_reviews(orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """Inner 1:n join: unreviewed orders drop out, multi-reviewed repeat."""
    return orders.join(reviews.select("order_id", "review_score"), "order_id", "inner")


def per_order_items(t: Tables) -> DataFrame:
    """Item aggregates plus the first line's category and weight."""
    summary = order_items_summary(t.items)
    prod = product_category(t.products, t.categories).select(
        "product_id", "product_category_name_english", "product_weight_g")
    return summary.join(prod, "product_id", "left").drop("product_id")


def located_customers(t: Tables, geo: DataFrame | None = None) -> DataFrame:
    geo = geo if geo is not None else geo_lookup(t.geolocation)
    g = geo.select(F.col("geolocation_zip_code_prefix").alias("customer_zip_code_prefix"),
                   F.col("lat").alias("cust_lat"), F.col("lng").alias("cust_lng"))
    return (t.customers.select("customer_id", "customer_state", "customer_zip_code_prefix")
            .join(g, "customer_zip_code_prefix", "left"))


def located_sellers(t: Tables, geo: DataFrame | None = None) -> DataFrame:
    geo = geo if geo is not None else geo_lookup(t.geolocation)
    g = geo.select(F.col("geolocation_zip_code_prefix").alias("seller_zip_code_prefix"),
                   F.col("lat").alias("sell_lat"), F.col("lng").alias("sell_lng"))
    return (t.sellers.select("seller_id", "seller_state", "seller_zip_code_prefix")
            .join(g, "seller_zip_code_prefix", "left"))


def build_master(t: Tables) -> DataFrame:
    """Clean and merge: one row per (delivered order, review) with distance."""
    geo = geo_lookup(t.geolocation)
    df = order_reviews(delivered_orders(t.orders), t.reviews)
    df = df.join(per_order_items(t), "order_id", "left")
    df = df.join(payment_profile(t.payments), "order_id", "left")
    df = df.join(located_customers(t, geo), "customer_id", "left")
    df = df.join(located_sellers(t, geo), "seller_id", "left")
    df = df.withColumn("distance_km", haversine_km(
        F.col("cust_lat"), F.col("cust_lng"), F.col("sell_lat"), F.col("sell_lng")))
    return df.select(*MASTER_BASE_COLUMNS)


def top_category_names(master: DataFrame, n: int = 5) -> list[str]:
    """The n most frequent English categories (a <= n row collect)."""
    col = "product_category_name_english"
    return [r[col] for r in top_values(master, col, n).collect()]


def timing_columns(df: DataFrame) -> DataFrame:
    ts = F.col("order_purchase_timestamp")
    actual = days_between(ts, F.col("order_delivered_customer_date"))
    estimated = days_between(ts, F.col("order_estimated_delivery_date"))
    return df.select(
        "*",
        actual.alias("actual_delivery_days"),
        estimated.alias("estimated_delivery_days"),
        (actual - estimated).alias("delivery_delay_days"),
        days_between(ts, F.col("order_delivered_carrier_date")).alias("carrier_handling_days"),
        flag(actual - estimated > 0).alias("is_late"),
    )


def engineer_features(master: DataFrame, top_categories: list[str] | None = None) -> DataFrame:
    """Row-local features (safe before the split).

    ``top_categories``: None -> the 5 most frequent categories of ``master``
    are fetched (one tiny collect); [] -> no ``cat_`` dummies.
    """
    if top_categories is None:
        top_categories = top_category_names(master)
    df = timing_columns(master)
    ts = F.col("order_purchase_timestamp")
    cat = F.col("product_category_name_english")
    ptype = F.col("primary_payment_type")
    return df.select(
        "*",
        F.concat(F.col("seller_state"), F.lit(" -> "), F.col("customer_state")).alias("corridor"),
        flag(F.col("customer_state") == F.col("seller_state")).alias("same_state"),
        distance_band(F.col("distance_km")).alias("distance_band"),
        *[flag(ptype == p).alias(f"pay_{p}") for p in PAYMENT_TYPES],
        *[flag(cat == c).alias(dummy_name(CATEGORY_PREFIX, c)) for c in top_categories],
        F.month(ts).alias("purchase_month"),
        weekday_monday0(ts).alias("purchase_dow"),
        F.hour(ts).alias("purchase_hour"),
        flag(F.col("review_score") >= 4).alias("satisfied"),
    )


def prepared_master(t: Tables, top_categories: list[str] | None = None) -> DataFrame:
    """Master with all features (48 columns with 5 category dummies)."""
    return engineer_features(build_master(t), top_categories)
