"""Geography and satisfaction (RQ1): same-state versus cross-state, shipping
corridors, customer states, and the tests on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routewise.operators.stats import (
    linear_trend,
    mann_whitney,
    mann_whitney_p,
    spearman,
    t_two_sided_p,
)


def same_vs_cross(df: DataFrame) -> DataFrame:
    """Satisfaction, volume and mean delay of same-state vs cross-state rows."""
    return (df.groupBy("same_state")
            .agg(F.avg("satisfied").alias("sat_rate"), F.count("order_id").alias("count"),
                 F.avg("delivery_delay_days").alias("avg_delay"))
            .select("same_state",
                    F.when(F.col("same_state") == 1, "Same State")
                    .when(F.col("same_state") == 0, "Cross State").alias("label"),
                    "sat_rate", "count", "avg_delay"))


def corridor_stats(df: DataFrame, min_orders: int = 50) -> DataFrame:
    """Per seller-state -> customer-state corridor: volume, satisfaction,
    mean distance, late rate; corridors below ``min_orders`` dropped."""
    return (df.filter(F.col("corridor").isNotNull())
            .groupBy("corridor")
            .agg(F.count("order_id").alias("n"), F.avg("satisfied").alias("sat_rate"),
                 F.avg("distance_km").alias("avg_distance"), F.avg("is_late").alias("late_rate"))
            .filter(F.col("n") >= min_orders))


def corridor_bubbles(corr: DataFrame, size_divisor: float = 5.0) -> DataFrame:
    """Scatter data: distance vs satisfaction %, bubble size, colour = late rate."""
    return corr.select("corridor", F.col("avg_distance").alias("x"),
                       (F.col("sat_rate") * 100).alias("y"),
                       (F.col("n") / size_divisor).alias("size"), F.col("late_rate").alias("colour"))


def state_satisfaction(df: DataFrame) -> DataFrame:
    """Per customer state: volume, satisfaction, above the national rate."""
    per_state = (df.groupBy("customer_state")
                 .agg(F.count("order_id").alias("n"), F.avg("satisfied").alias("sat_rate"),
                      F.sum("satisfied").alias("_sat"), F.count("satisfied").alias("_nsat")))
    # one row per state (+ the NULL state): the national mean is a window
    # over that small table, computed before the NULL state is dropped
    everything = Window.partitionBy()
    national = F.sum("_sat").over(everything) / F.sum("_nsat").over(everything)
    return (per_state.select("customer_state", "n", "sat_rate",
                             (F.col("sat_rate") > national).cast("int").alias("above_national"))
            .filter(F.col("customer_state").isNotNull())
            .orderBy("sat_rate", "customer_state"))


def same_state_test(df: DataFrame) -> DataFrame:
    """Mann-Whitney on review scores, same-state > cross-state."""
    return mann_whitney(df, "review_score", "same_state", first=1, second=0)


def corridor_spearman(corr: DataFrame) -> DataFrame:
    return spearman(corr, "avg_distance", "sat_rate")


def distance_trend(corr: DataFrame) -> DataFrame:
    """Degree-1 fit of satisfaction % on corridor distance."""
    return linear_trend(corr.withColumn("sat_pct", F.col("sat_rate") * 100), "avg_distance", "sat_pct")


def statistical_tests(df: DataFrame, min_orders: int = 50, with_p: bool = True) -> DataFrame:
    """The two RQ1 tests as rows (Test, Statistic, Effect_Size[, p_value]).

    Both test results are one-row aggregates; the p-values are scalar
    functions of those rows (normal tail, Student t tail).
    """
    mw = same_state_test(df).select(
        F.lit("Mann-Whitney U (same vs cross-state)").alias("Test"),
        F.col("u_stat").alias("Statistic"),
        F.concat(F.lit("rank-biserial r="), F.format_number(F.col("r_rb"), 4)).alias("Effect_Size"),
        F.col("z").alias("_z"), F.lit(None).cast("bigint").alias("_n"),
        F.col("n1").alias("_n1"), F.col("n2").alias("_n2"), F.col("tie_term").alias("_ties"))
    sp = corridor_spearman(corridor_stats(df, min_orders)).select(
        F.lit("Spearman (corridor distance vs satisfaction)").alias("Test"),
        F.col("rho").alias("Statistic"),
        F.concat(F.lit("rho="), F.format_number(F.col("rho"), 3)).alias("Effect_Size"),
        F.col("t_stat").alias("_z"), F.col("n").alias("_n"), F.lit(None).cast("bigint").alias("_n1"),
        F.lit(None).cast("bigint").alias("_n2"), F.lit(None).cast("double").alias("_ties"))
    both = mw.unionByName(sp)
    if not with_p:
        return both.drop("_z", "_n", "_n1", "_n2", "_ties")
    rows = both.collect()  # two rows
    spark = df.sparkSession
    out = []
    for r in rows:
        if r["_n"] is None:
            p = mann_whitney_p(r["_n1"], r["_n2"], r["Statistic"], r["_z"], r["_ties"])
        else:
            p = t_two_sided_p(r["_z"], r["_n"] - 2)
        out.append((r["Test"], r["Statistic"], p, r["Effect_Size"]))
    return spark.createDataFrame(
        out, "Test string, Statistic double, p_value double, Effect_Size string")
