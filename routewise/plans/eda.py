"""Exploratory summaries: score distribution, class balance, delay bands,
correlation matrix. All are aggregates over the master table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routewise.functions import delay_band, delay_band_order
from routewise.operators.stats import pearson_matrix

# The columns of the correlation matrix.
CORRELATION_COLUMNS = [
    "distance_km", "actual_delivery_days", "delivery_delay_days", "total_order_value",
    "freight_ratio", "num_items", "payment_installments", "satisfied",
]


def review_distribution(df: DataFrame) -> DataFrame:
    """Rows per review score, in score order."""
    return (df.filter(F.col("review_score").isNotNull()).groupBy("review_score")
            .agg(F.count(F.lit(1)).alias("n")).orderBy("review_score"))


def satisfaction_rate(df: DataFrame) -> DataFrame:
    """Class balance: rows per ``satisfied`` value and share of all rows."""
    counts = df.groupBy("satisfied").agg(F.count(F.lit(1)).alias("n"))
    # the grouped table has at most 3 rows: a global window over it is free
    total = F.sum("n").over(Window.partitionBy())
    return (counts.select("satisfied", "n", (F.col("n") / total).alias("share"))
            .orderBy(F.desc("satisfied")))


def delay_band_satisfaction(df: DataFrame) -> DataFrame:
    """Satisfaction rate and row count per delivery-delay band (observed
    bands only, NULL delay dropped), plus the overall rate on every row."""
    banded = df.select(delay_band(F.col("delivery_delay_days")).alias("delay_band"),
                       delay_band_order(F.col("delivery_delay_days")).alias("band_order"),
                       "satisfied", "order_id")
    per_band = (banded.groupBy("delay_band", "band_order")
                .agg(F.sum("satisfied").alias("_sat"), F.count("satisfied").alias("_nsat"),
                     F.avg("satisfied").alias("sat_rate"), F.count("order_id").alias("count")))
    # <= 5 grouped rows (4 bands + NULL): the overall rate is a window over them
    everything = Window.partitionBy()
    overall = F.sum("_sat").over(everything) / F.sum("_nsat").over(everything)
    return (per_band.select("delay_band", "band_order", "sat_rate", "count",
                            overall.alias("overall_sat_rate"))
            .filter(F.col("delay_band").isNotNull()).orderBy("band_order"))


def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return pearson_matrix(df, cols or CORRELATION_COLUMNS)
