"""Seller-level work: leakage-safe seller features for the models (RQ2) and
seller benchmarking and segmentation (RQ3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routewise.operators.quantiles import medians_row

# Column lists of the seller analyses.
SELLER_FEATURES = ["seller_order_count", "seller_avg_review", "seller_late_rate",
                   "seller_avg_distance"]
CLUSTER_COLUMNS = ["avg_review", "late_rate", "avg_distance", "avg_delivery_days",
                   "order_count", "avg_order_value"]
LOG_COLUMNS = ["order_count", "avg_order_value", "avg_distance"]
RADAR_COLUMNS = ["avg_review", "sat_rate", "late_rate", "avg_distance", "avg_delivery_days",
                 "order_count"]
RADAR_INVERTED = ["late_rate", "avg_distance", "avg_delivery_days"]

# Segment names and strategy texts.
TOP, AT_RISK, HIGH_VOLUME, DEVELOPING = "Top Performers", "At-Risk", "High Volume", "Developing"
REWARD = "Reward: featured placement, reduced commission"
IMPROVE = "Improve: logistics support, delivery monitoring"
SUPPORT = "Support: quality guidelines, feedback loops"
MAINTAIN = "Maintain: standard monitoring, periodic review"


# --------------------------------------------------------------------------
# RQ2: seller features from the training period only
# --------------------------------------------------------------------------

def seller_stats(train: DataFrame) -> DataFrame:
    """Per seller, from training rows only (NULL seller dropped)."""
    return (train.filter(F.col("seller_id").isNotNull()).groupBy("seller_id")
            .agg(F.count("order_id").cast("double").alias("seller_order_count"),
                 F.avg("review_score").alias("seller_avg_review"),
                 F.avg("is_late").alias("seller_late_rate"),
                 F.avg("distance_km").alias("seller_avg_distance")))


def fill_with(df: DataFrame, stats_row: DataFrame, cols: list[str]) -> DataFrame:
    """Replace NULLs in ``cols`` by the values of the one-row ``stats_row``
    (fetched as driver scalars: one bounded row, then literals in the plan)."""
    row = stats_row.select(*cols).first()
    return df.select(*[
        F.coalesce(F.col(c), F.lit(row[c]).cast(df.schema[c].dataType)).alias(c)
        if c in cols and row is not None and row[c] is not None else F.col(c)
        for c in df.columns])


def add_seller_features(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attach train-derived seller stats to both parts; sellers unseen in
    train get the median over the *joined training rows* (row-weighted)."""
    stats = seller_stats(train)
    tr = train.join(stats, "seller_id", "left").select(*train.columns, *SELLER_FEATURES)
    te = test.join(stats, "seller_id", "left").select(*test.columns, *SELLER_FEATURES)
    meds = medians_row(tr, SELLER_FEATURES)
    return fill_with(tr, meds, SELLER_FEATURES), fill_with(te, meds, SELLER_FEATURES)


def cold_start(train: DataFrame, test: DataFrame) -> DataFrame:
    """How many test rows have a seller seen in training."""
    seen = (train.filter(F.col("seller_id").isNotNull()).select("seller_id").distinct()
            .withColumn("_seen", F.lit(1)))
    n_sellers = seen.agg(F.count(F.lit(1))).scalar()
    return (test.select("seller_id").join(seen, "seller_id", "left")
            .agg(F.count(F.lit(1)).alias("test_rows"),
                 F.count("_seen").alias("seen_rows"))
            .select(n_sellers.alias("train_sellers"), "test_rows", "seen_rows",
                    (F.col("test_rows") - F.col("seen_rows")).alias("unseen_rows")))


# --------------------------------------------------------------------------
# RQ3: seller benchmarking
# --------------------------------------------------------------------------

def seller_performance(df: DataFrame, min_orders: int = 5) -> DataFrame:
    """Per seller over the whole master: volume and six means, sellers with
    at least ``min_orders`` rows."""
    return (df.filter(F.col("seller_id").isNotNull()).groupBy("seller_id")
            .agg(F.count("order_id").alias("order_count"),
                 F.avg("review_score").alias("avg_review"),
                 F.avg("satisfied").alias("sat_rate"),
                 F.avg("is_late").alias("late_rate"),
                 F.avg("distance_km").alias("avg_distance"),
                 F.avg("actual_delivery_days").alias("avg_delivery_days"),
                 F.avg("total_order_value").alias("avg_order_value"))
            .filter(F.col("order_count") >= min_orders))


def clustering_inputs(sellers: DataFrame) -> DataFrame:
    """Median-filled clustering columns, log1p on the skewed three."""
    meds = medians_row(sellers, CLUSTER_COLUMNS)
    filled = fill_with(sellers.select("seller_id", *CLUSTER_COLUMNS), meds, CLUSTER_COLUMNS)
    return filled.select("seller_id", *[
        (F.log1p(F.col(c)) if c in LOG_COLUMNS else F.col(c).cast("double")).alias(c)
        for c in CLUSTER_COLUMNS])


def _small(df: DataFrame) -> DataFrame:
    """Materialise a table of a few rows (k segment rows) once, so the
    several statistics over it do not recompute the seller aggregate."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def segment_names(sellers: DataFrame, segment_col: str = "segment") -> DataFrame:
    """Rule names per segment from the segment means (k rows):

    Top Performers: review >= q70 and late rate <= q30 of the segment means;
    At-Risk: late rate >= q70; High Volume: order count >= median;
    else Developing. A repeated name gets " (2)", " (3)" in segment order.
    Quantiles interpolate linearly between the k means.
    """
    means = _small(sellers.groupBy(segment_col).agg(
        *[F.avg(c).alias(c) for c in CLUSTER_COLUMNS + ["sat_rate"]]))
    q = means.agg(F.percentile("avg_review", 0.7).alias("r70"),
                  F.percentile("late_rate", 0.3).alias("l30"),
                  F.percentile("late_rate", 0.7).alias("l70"),
                  F.percentile("order_count", 0.5).alias("o50")).first()
    lit = lambda v: F.lit(v).cast("double")
    base = (F.when((F.col("avg_review") >= lit(q["r70"])) & (F.col("late_rate") <= lit(q["l30"])), TOP)
            .when(F.col("late_rate") >= lit(q["l70"]), AT_RISK)
            .when(F.col("order_count") >= lit(q["o50"]), HIGH_VOLUME)
            .otherwise(DEVELOPING))
    named = means.select(segment_col, base.alias("_base"))
    rn = F.row_number().over(Window.partitionBy("_base").orderBy(segment_col))
    return named.select(
        segment_col,
        F.when(rn == 1, F.col("_base"))
        .otherwise(F.concat(F.col("_base"), F.lit(" ("), rn.cast("string"), F.lit(")")))
        .alias("segment_name"))


def name_sellers(sellers: DataFrame, segment_col: str = "segment") -> DataFrame:
    names = segment_names(sellers, segment_col)
    # k rows (k = number of clusters, <= 6): a bounded broadcast
    return sellers.join(F.broadcast(names), segment_col)


def segment_profile(named: DataFrame, decimals: int = 3) -> DataFrame:
    """Per segment name: seller count and five means, rounded half-even."""
    r = lambda c: F.bround(c, decimals)
    return (named.groupBy("segment_name")
            .agg(F.count("seller_id").alias("n"),
                 r(F.avg("avg_review")).alias("avg_review"), r(F.avg("sat_rate")).alias("sat_rate"),
                 r(F.avg("late_rate")).alias("late_rate"), r(F.avg("order_count")).alias("avg_orders"),
                 r(F.avg("avg_distance")).alias("avg_distance"))
            .orderBy("segment_name"))


def segment_radar(named: DataFrame) -> DataFrame:
    """Segment means scaled to [0, 1] across segments; lower-is-better
    columns inverted; a column constant across segments gives NULL."""
    means = named.groupBy("segment_name").agg(*[F.avg(c).alias(c) for c in RADAR_COLUMNS])
    allseg = Window.partitionBy()  # over the k segment rows
    cols = []
    for c in RADAR_COLUMNS:
        lo, hi = F.min(c).over(allseg), F.max(c).over(allseg)
        norm = F.try_divide(F.col(c) - lo, hi - lo)
        cols.append((F.lit(1.0) - norm if c in RADAR_INVERTED else norm).alias(c))
    return means.select("segment_name", *cols).orderBy("segment_name")


def recommendations(profile: DataFrame) -> DataFrame:
    """Strategy per segment from the rounded profile."""
    med = F.lit(profile.agg(F.percentile("sat_rate", 0.5)).first()[0]).cast("double")
    strategy = (F.when((F.col("sat_rate") > 0.8) & (F.col("late_rate") < 0.1), REWARD)
                .when(F.col("late_rate") > 0.15, IMPROVE)
                .when(F.col("sat_rate") < med, SUPPORT)
                .otherwise(MAINTAIN))
    pct = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    return profile.select(F.col("segment_name").alias("Segment"), F.col("n").alias("Sellers"),
                          pct("sat_rate").alias("Satisfaction"), pct("late_rate").alias("Late_Rate"),
                          strategy.alias("Strategy"))


def seller_scatter(named: DataFrame) -> DataFrame:
    return named.select("seller_id", "segment_name",
                        (F.col("late_rate") * 100).alias("late_pct"),
                        (F.col("sat_rate") * 100).alias("sat_pct"),
                        (F.col("order_count") * 0.5).alias("size"))


def given_segments(sellers: DataFrame, n_segments: int = 4) -> DataFrame:
    """Deterministic segment ids (seller_id mod n) — lets the naming rules
    be checked against an oracle, since cluster ids are arbitrary."""
    return sellers.withColumn("segment", (F.col("seller_id") % n_segments).cast("int"))
