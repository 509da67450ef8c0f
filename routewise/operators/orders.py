"""Per-order and per-key pre-aggregations (aggregate before the fact join).

Catalyst does not push a GROUP BY below a join, so every one-to-many side
is reduced to one row per key here, with a partial (map-side) aggregate,
before it meets the order/review fact rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewise.functions import safe_ratio

# Positional "first" in the source file has no meaning in an unordered
# table; the order lines are ranked by this explicit total key instead.
ITEM_ORDER = ("order_item_id", "product_id", "seller_id")


def order_items_summary(items: DataFrame) -> DataFrame:
    """One row per order from its item lines (single shuffle of ``items``).

    * ``seller_id``: seller of the first line whose seller is not NULL
    * ``product_id``: product of the first line, NULL kept
    * sums of price and freight (0 when every value is NULL), line count
    * order value and freight ratio (0/0 -> 0)
    """
    line = F.struct(*[F.col(c) for c in ITEM_ORDER])
    agg = items.groupBy("order_id").agg(
        F.min(F.when(F.col("seller_id").isNotNull(), line)).getField("seller_id").alias("seller_id"),
        F.min(line).getField("product_id").alias("product_id"),
        F.coalesce(F.sum("price"), F.lit(0.0)).alias("total_price"),
        F.coalesce(F.sum("freight_value"), F.lit(0.0)).alias("total_freight"),
        F.count("order_item_id").alias("num_items"),
    )
    value = F.col("total_price") + F.col("total_freight")
    return agg.select(
        "order_id", "seller_id", "product_id", "total_price", "total_freight", "num_items",
        value.alias("total_order_value"),
        safe_ratio(F.col("total_freight"), value).alias("freight_ratio"),
    )


def order_item_aggregates(items: DataFrame) -> DataFrame:
    """Item aggregates only (seller, sums, count, value, ratio)."""
    return order_items_summary(items).drop("product_id")


def payment_profile(payments: DataFrame) -> DataFrame:
    """Per order: most installments, most frequent payment type (ties ->
    smallest name, NULL types ignored)."""
    return payments.groupBy("order_id").agg(
        F.max("payment_installments").alias("payment_installments"),
        F.mode("payment_type", deterministic=True).alias("primary_payment_type"),
    )


def product_category(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Products with their English category (NULL category stays unmatched)."""
    return products.join(categories, "product_category_name", "left").select(
        "product_id", "product_category_name", "product_category_name_english", "product_weight_g")


def primary_product(summary: DataFrame, products: DataFrame, categories: DataFrame) -> DataFrame:
    """First line's product per order, resolved to category and weight."""
    prod = product_category(products, categories).select(
        "product_id", "product_category_name_english", "product_weight_g")
    return summary.select("order_id", "product_id").join(prod, "product_id", "left").select(
        "order_id", "product_category_name_english", "product_weight_g")


def geo_lookup(geolocation: DataFrame) -> DataFrame:
    """Exact median latitude / longitude per zip prefix (NULL zips dropped; zips
    whose coordinates are all NULL get a (NULL, NULL) row). Both coordinates go
    through the same two passes, and a zip holding a third of all rows leaves
    only the values near its medians to rank."""
    from routewise.operators.quantiles import quantiles_by_group

    zip_col = "geolocation_zip_code_prefix"
    rows = geolocation.filter(F.col(zip_col).isNotNull()).select(
        zip_col, F.col("geolocation_lat").alias("lat"), F.col("geolocation_lng").alias("lng"))
    return quantiles_by_group(rows, [zip_col], ["lat", "lng"])


def top_values(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    """The ``n`` most frequent non-NULL values (ties -> smaller value first)."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).count()
            .orderBy(F.desc("count"), F.asc(col)).limit(n))
