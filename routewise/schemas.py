"""Typed column lists of the nine marketplace inputs.

Only the columns the analytics touch are typed; readers select them by
name, so extra columns in a source file are tolerated and ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

# table -> ordered (column, Spark SQL type) pairs
RAW_COLUMNS: dict[str, list[tuple[str, str]]] = {
    "orders": [
        ("order_id", "string"), ("customer_id", "string"), ("order_status", "string"),
        ("order_purchase_timestamp", "timestamp_ntz"), ("order_approved_at", "timestamp_ntz"),
        ("order_delivered_carrier_date", "timestamp_ntz"),
        ("order_delivered_customer_date", "timestamp_ntz"),
        ("order_estimated_delivery_date", "timestamp_ntz"),
    ],
    "reviews": [("order_id", "string"), ("review_score", "int")],
    "items": [
        ("order_id", "string"), ("order_item_id", "int"), ("product_id", "string"),
        ("seller_id", "string"), ("price", "double"), ("freight_value", "double"),
    ],
    "payments": [
        ("order_id", "string"), ("payment_sequential", "int"), ("payment_type", "string"),
        ("payment_installments", "int"),
    ],
    "products": [
        ("product_id", "string"), ("product_category_name", "string"),
        ("product_weight_g", "double"),
    ],
    "categories": [
        ("product_category_name", "string"), ("product_category_name_english", "string"),
    ],
    "customers": [
        ("customer_id", "string"), ("customer_state", "string"),
        ("customer_zip_code_prefix", "int"),
    ],
    "sellers": [
        ("seller_id", "string"), ("seller_state", "string"), ("seller_zip_code_prefix", "int"),
    ],
    "geolocation": [
        ("geolocation_zip_code_prefix", "int"), ("geolocation_lat", "double"),
        ("geolocation_lng", "double"),
    ],
}

# File names of the public marketplace dataset's nine CSVs.
RAW_FILES: dict[str, str] = {
    "orders": "olist_orders_dataset.csv",
    "reviews": "olist_order_reviews_dataset.csv",
    "items": "olist_order_items_dataset.csv",
    "payments": "olist_order_payments_dataset.csv",
    "products": "olist_products_dataset.csv",
    "customers": "olist_customers_dataset.csv",
    "sellers": "olist_sellers_dataset.csv",
    "geolocation": "olist_geolocation_dataset.csv",
    "categories": "product_category_name_translation.csv",
}

TIMESTAMP_COLUMNS = [
    "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
    "order_delivered_customer_date", "order_estimated_delivery_date",
]


@dataclass
class Tables:
    """The nine inputs as lazy DataFrames."""

    orders: DataFrame
    reviews: DataFrame
    items: DataFrame
    payments: DataFrame
    products: DataFrame
    categories: DataFrame
    customers: DataFrame
    sellers: DataFrame
    geolocation: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}
