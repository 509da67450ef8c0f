"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` and the
matching DuckDB oracle SQL.

Every query reads the driver tables through the commerce-shaped views
(``routewise.sources.fixtures``) and runs over the whole tables. Doubles
are rounded to 6 decimals in both engines; aggregates are aliased to the
same names on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routewise.operators.orders import (
    geo_lookup,
    order_items_summary,
    payment_profile,
    product_category,
    top_values,
)
from routewise.operators import cluster as cl
from routewise.operators import evaluate as ev
from routewise.operators.pairwise import knn, silhouette_score
from routewise.operators.quantiles import medians_row
from routewise.operators.smote import dense_positions, draws_sql, smote, stratified_folds
from routewise.operators.split import chronological_split, split_summary
from routewise.plans import corridors, eda, sellers
from routewise.plans import prediction as pr
from routewise.plans.oracle import FIXTURE_CTES, on_master, with_ctes
from routewise.plans.pipeline import distance_coverage
from routewise.session import cut_lineage, save_table
from routewise.plans.prepare import (
    MASTER_BASE_COLUMNS,
    build_master,
    delivered_orders,
    engineer_features,
    order_reviews,
    top_category_names,
)
from routewise.sources import fixture_tables, table_profile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (stable cross-engine comparison)."""
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


def R(x: str, digits: int = 6) -> str:  # noqa: N802 - SQL helper
    return f"round({x}, {digits})"


# ---------------------------------------------------------------- helpers --

def _tables(spark, sf):
    return fixture_tables(spark, sf)


def _features(spark, sf, cats: list[str] | None = ()):
    """Master with features; no category dummies unless asked for."""
    master = build_master(_tables(spark, sf))
    return engineer_features(master, None if cats is None else list(cats))


def _labelled(spark, sf):
    return chronological_split(_features(spark, sf))


def _train_test(spark, sf):
    lab = _labelled(spark, sf)
    return (lab.filter(F.col("is_train") == 1).drop("is_train"),
            lab.filter(F.col("is_train") == 0).drop("is_train"))


ROW_KEY = ["order_id", "review_score"]

# ============================================================ 2.1 sources ==

@register("q_shape_orders", with_ctes(FIXTURE_CTES, body="SELECT * FROM c_orders"))
def q_shape_orders(spark, sf):
    return _tables(spark, sf).orders


TABLE_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS n_rows, CAST({ncol} AS BIGINT) AS n_cols FROM c_{view}"
    for name, view, ncol in [("orders", "orders", 8), ("reviews", "reviews", 2), ("items", "items", 6),
                             ("payments", "payments", 4), ("products", "products", 3),
                             ("categories", "categories", 2), ("customers", "customers", 3),
                             ("sellers", "sellers", 3), ("geolocation", "geo", 3)])


@register("q_table_profile", with_ctes(FIXTURE_CTES, body=TABLE_SQL))
def q_table_profile(spark, sf):
    return table_profile(_tables(spark, sf))

# ======================================================= 2.2 projections ==

@register("q_delivered_orders", on_master("SELECT * FROM d_orders"))
def q_delivered_orders(spark, sf):
    return delivered_orders(_tables(spark, sf).orders)


@register("q_orders_reviews", on_master(
    "SELECT o.order_id, o.customer_id, o.order_purchase_timestamp, r.review_score "
    "FROM d_orders o JOIN c_reviews r ON o.order_id = r.order_id"))
def q_orders_reviews(spark, sf):
    t = _tables(spark, sf)
    return order_reviews(delivered_orders(t.orders), t.reviews).select(
        "order_id", "customer_id", "order_purchase_timestamp", "review_score")


@register("q_order_items", on_master(
    f"SELECT order_id, seller_id, {R('total_price')} AS total_price, {R('total_freight')} AS total_freight, "
    f"num_items, {R('total_order_value')} AS total_order_value, {R('freight_ratio')} AS freight_ratio "
    "FROM items_agg"))
def q_order_items(spark, sf):
    s = order_items_summary(_tables(spark, sf).items)
    return rounded(s.select("order_id", "seller_id", "total_price", "total_freight", "num_items",
                            "total_order_value", "freight_ratio"))


@register("q_order_value", on_master(
    f"SELECT order_id, review_score, {R('total_price')} AS total_price, {R('total_freight')} AS total_freight, "
    f"num_items, {R('total_order_value')} AS total_order_value, {R('freight_ratio')} AS freight_ratio FROM master"))
def q_order_value(spark, sf):
    m = build_master(_tables(spark, sf))
    return rounded(m.select(*ROW_KEY, "total_price", "total_freight", "num_items",
                            "total_order_value", "freight_ratio"))


@register("q_payment_profile", on_master(
    "SELECT order_id, payment_installments, primary_payment_type FROM pay_agg"))
def q_payment_profile(spark, sf):
    return payment_profile(_tables(spark, sf).payments)


@register("q_product_category", on_master(
    "SELECT p.product_id, p.product_category_name, c.product_category_name_english, "
    f"{R('p.product_weight_g')} AS product_weight_g FROM c_products p "
    "LEFT JOIN c_categories c ON p.product_category_name = c.product_category_name"))
def q_product_category(spark, sf):
    t = _tables(spark, sf)
    return rounded(product_category(t.products, t.categories))


@register("q_primary_product", on_master(
    "SELECT i.order_id, i.product_id, pr.product_category_name_english, "
    f"{R('pr.product_weight_g')} AS product_weight_g FROM items_agg i LEFT JOIN prod pr ON i.product_id = pr.product_id"))
def q_primary_product(spark, sf):
    t = _tables(spark, sf)
    s = order_items_summary(t.items).select("order_id", "product_id")
    prod = product_category(t.products, t.categories)
    return rounded(s.join(prod, "product_id", "left").select(
        "order_id", "product_id", "product_category_name_english", "product_weight_g"))


@register("q_geo_lookup", on_master(
    f"SELECT geolocation_zip_code_prefix, {R('lat')} AS lat, {R('lng')} AS lng FROM geo"))
def q_geo_lookup(spark, sf):
    return rounded(geo_lookup(_tables(spark, sf).geolocation))


_BASE_SQL_COLS = ", ".join(
    R(c) + f" AS {c}" if c in {"total_price", "total_freight", "total_order_value", "freight_ratio",
                               "product_weight_g", "cust_lat", "cust_lng", "sell_lat", "sell_lng",
                               "distance_km"} else c
    for c in MASTER_BASE_COLUMNS)


@register("q_master", on_master(f"SELECT {_BASE_SQL_COLS} FROM master"))
def q_master(spark, sf):
    return rounded(build_master(_tables(spark, sf)))


@register("q_haversine", on_master(
    f"SELECT order_id, review_score, {R('cust_lat')} AS cust_lat, {R('cust_lng')} AS cust_lng, "
    f"{R('sell_lat')} AS sell_lat, {R('sell_lng')} AS sell_lng, {R('distance_km')} AS distance_km FROM master"))
def q_haversine(spark, sf):
    m = build_master(_tables(spark, sf))
    return rounded(m.select(*ROW_KEY, "cust_lat", "cust_lng", "sell_lat", "sell_lng", "distance_km"))


@register("q_delivery_timing", on_master(
    f"SELECT order_id, review_score, {R('actual_delivery_days')} AS actual_delivery_days, "
    f"{R('estimated_delivery_days')} AS estimated_delivery_days, {R('delivery_delay_days')} AS delivery_delay_days, "
    f"{R('carrier_handling_days')} AS carrier_handling_days, is_late FROM feat"))
def q_delivery_timing(spark, sf):
    return rounded(_features(spark, sf).select(
        *ROW_KEY, "actual_delivery_days", "estimated_delivery_days", "delivery_delay_days",
        "carrier_handling_days", "is_late"))


@register("q_geo_features", on_master(
    "SELECT order_id, review_score, seller_state, customer_state, corridor, same_state FROM feat"))
def q_geo_features(spark, sf):
    return _features(spark, sf).select(*ROW_KEY, "seller_state", "customer_state", "corridor",
                                       "same_state")


@register("q_distance_band", on_master(
    "SELECT distance_band, count(*) AS n FROM feat GROUP BY distance_band"))
def q_distance_band(spark, sf):
    return _features(spark, sf).groupBy("distance_band").agg(F.count(F.lit(1)).alias("n"))


@register("q_payment_dummies", on_master(
    "SELECT order_id, review_score, primary_payment_type, pay_credit_card, pay_boleto, pay_debit_card FROM feat"))
def q_payment_dummies(spark, sf):
    return _features(spark, sf).select(*ROW_KEY, "primary_payment_type", "pay_credit_card",
                                       "pay_boleto", "pay_debit_card")


@register("q_top_categories", on_master(
    "SELECT product_category_name_english, count(*) AS n FROM feat "
    "WHERE product_category_name_english IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5"))
def q_top_categories(spark, sf):
    m = build_master(_tables(spark, sf))
    return top_values(m, "product_category_name_english", 5).withColumnRenamed("count", "n")


@register("q_category_dummies", on_master(
    "SELECT product_category_name_english AS category, "
    "'cat_' || replace(product_category_name_english, ' ', '_') AS column_name, count(*) AS n_rows "
    "FROM feat WHERE product_category_name_english IS NOT NULL GROUP BY 1 ORDER BY n_rows DESC, 1 LIMIT 5"))
def q_category_dummies(spark, sf):
    master = build_master(_tables(spark, sf))
    cats = top_category_names(master)
    feat = engineer_features(master, cats)
    cols = [c for c in feat.columns if c.startswith("cat_")]
    sums = feat.agg(*[F.sum(c).alias(c) for c in cols])
    pairs = [x for cat, c in zip(cats, cols) for x in (F.lit(cat), F.lit(c), F.col(c))]
    return sums.select(F.stack(F.lit(len(cols)), *pairs).alias("category", "column_name", "n_rows"))


@register("q_purchase_calendar", on_master(
    "SELECT order_id, review_score, order_purchase_timestamp, purchase_month, purchase_dow, purchase_hour FROM feat"))
def q_purchase_calendar(spark, sf):
    return _features(spark, sf).select(*ROW_KEY, "order_purchase_timestamp", "purchase_month",
                                       "purchase_dow", "purchase_hour")

# ======================================================== 2.4 aggregates ==

@register("q_satisfaction_rate", on_master(
    f"SELECT satisfied, count(*) AS n, {R('count(*) / sum(count(*)) OVER ()')} AS share FROM feat GROUP BY satisfied"))
def q_satisfaction_rate(spark, sf):
    return rounded(eda.satisfaction_rate(_features(spark, sf)))


@register("q_review_distribution", on_master(
    "SELECT review_score, count(*) AS n FROM feat WHERE review_score IS NOT NULL GROUP BY 1 ORDER BY 1"))
def q_review_distribution(spark, sf):
    return eda.review_distribution(_features(spark, sf))


_DELAY_SQL = """
banded AS (
  SELECT satisfied, order_id,
    CASE WHEN delivery_delay_days <= -7 THEN 'Very Early\n(>7d early)'
         WHEN delivery_delay_days > -7 AND delivery_delay_days <= 0 THEN 'On Time\n(0-7d early)'
         WHEN delivery_delay_days > 0 AND delivery_delay_days <= 7 THEN 'Slight Delay\n(0-7d late)'
         WHEN delivery_delay_days > 7 THEN 'Severe Delay\n(>7d late)' END AS delay_band,
    CASE WHEN delivery_delay_days <= -7 THEN 0 WHEN delivery_delay_days <= 0 THEN 1
         WHEN delivery_delay_days <= 7 THEN 2 WHEN delivery_delay_days > 7 THEN 3 END AS band_order
  FROM feat)"""


@register("q_delay_band", on_master(
    f"SELECT delay_band, band_order, {R('avg(satisfied)')} AS sat_rate, count(order_id) AS count, "
    f"{R('(SELECT avg(satisfied) FROM feat)')} AS overall_sat_rate "
    "FROM banded WHERE delay_band IS NOT NULL GROUP BY delay_band, band_order", _DELAY_SQL))
def q_delay_band(spark, sf):
    return rounded(eda.delay_band_satisfaction(_features(spark, sf)))


@register("q_same_vs_cross", on_master(
    "SELECT same_state, CASE same_state WHEN 1 THEN 'Same State' WHEN 0 THEN 'Cross State' END AS label, "
    f"{R('avg(satisfied)')} AS sat_rate, count(order_id) AS count, {R('avg(delivery_delay_days)')} AS avg_delay "
    "FROM feat GROUP BY same_state"))
def q_same_vs_cross(spark, sf):
    return rounded(corridors.same_vs_cross(_features(spark, sf)))


_CORRIDOR_SQL = """
corr AS (
  SELECT corridor, count(order_id) AS n, avg(satisfied) AS sat_rate, avg(distance_km) AS avg_distance,
         avg(is_late) AS late_rate
  FROM feat WHERE corridor IS NOT NULL GROUP BY corridor HAVING count(order_id) >= 50)"""


@register("q_corridor", on_master(
    f"SELECT corridor, n, {R('sat_rate')} AS sat_rate, {R('avg_distance')} AS avg_distance, "
    f"{R('late_rate')} AS late_rate FROM corr", _CORRIDOR_SQL))
def q_corridor(spark, sf, min_orders: int = 50):
    return rounded(corridors.corridor_stats(_features(spark, sf), min_orders))


@register("q_state_satisfaction", on_master(
    f"SELECT customer_state, count(order_id) AS n, {R('avg(satisfied)')} AS sat_rate, "
    "CAST(avg(satisfied) > (SELECT avg(satisfied) FROM feat) AS INTEGER) AS above_national "
    "FROM feat WHERE customer_state IS NOT NULL GROUP BY customer_state"))
def q_state_satisfaction(spark, sf):
    return rounded(corridors.state_satisfaction(_features(spark, sf)))


@register("q_distance_coverage", on_master(
    f"SELECT count(*) AS n_rows, count(distance_km) AS n_with_distance, "
    f"{R('avg(CAST(distance_km IS NOT NULL AS INTEGER))')} AS coverage FROM master"))
def q_distance_coverage(spark, sf):
    m = build_master(_tables(spark, sf))
    return rounded(distance_coverage(m))

# ============================================================ 2.6 stats ==

_CORR_COLS = eda.CORRELATION_COLUMNS
_CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS var_x, '{b}' AS var_y, {R(f'corr({a}, {b})')} AS r FROM cc"
    for a in _CORR_COLS for b in _CORR_COLS)


@register("q_correlation", on_master(
    _CORR_SQL, f"cc AS (SELECT {', '.join(_CORR_COLS)} FROM feat WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in _CORR_COLS) + ")"))
def q_correlation(spark, sf):
    return rounded(eda.correlation_matrix(_features(spark, sf)))


_MW_SQL = """
mw_h AS (
  SELECT review_score AS v, count(*) FILTER (WHERE same_state = 1) AS a, count(*) FILTER (WHERE same_state = 0) AS b
  FROM feat WHERE review_score IS NOT NULL GROUP BY review_score),
mw_c AS (SELECT *, sum(b) OVER (ORDER BY v) - b AS below FROM mw_h),
mw AS (
  SELECT CAST(sum(a) AS BIGINT) AS n1, CAST(sum(b) AS BIGINT) AS n2, sum(a * (below + b / 2.0E0)) AS u1,
         CAST(sum((a + b) * (a + b) * (a + b) - (a + b)) AS DOUBLE) AS tie_term FROM mw_c)"""


@register("q_mann_whitney", on_master(
    f"SELECT n1, n2, {R('u1')} AS u_stat, "
    f"{R('(u1 - n1 * n2 / 2.0E0 - 0.5E0) / sqrt(n1 * n2 / 12.0E0 * ((n1 + n2 + 1) - tie_term / ((n1 + n2) * (n1 + n2 - 1.0E0))))')} AS z, "
    f"{R('1.0E0 - 2.0E0 * u1 / (n1 * n2)')} AS r_rb, {R('tie_term')} AS tie_term FROM mw", _MW_SQL))
def q_mann_whitney(spark, sf):
    return rounded(corridors.same_state_test(_features(spark, sf)))


_SPEARMAN_SQL = _CORRIDOR_SQL + """,
sp AS (
  SELECT avg_distance, sat_rate,
    rank() OVER (ORDER BY avg_distance) + (count(*) OVER (PARTITION BY avg_distance) - 1) / 2.0E0 AS rx,
    rank() OVER (ORDER BY sat_rate) + (count(*) OVER (PARTITION BY sat_rate) - 1) / 2.0E0 AS ry
  FROM corr WHERE avg_distance IS NOT NULL AND sat_rate IS NOT NULL),
sp1 AS (SELECT count(*) AS n,
               CASE WHEN (SELECT count(*) FROM corr WHERE avg_distance IS NULL OR sat_rate IS NULL) > 0
                    THEN NULL ELSE corr(rx, ry) END AS rho FROM sp)"""


@register("q_spearman", on_master(
    f"SELECT n, {R('rho')} AS rho, {R('rho * sqrt((n - 2) / (1.0E0 - rho * rho))')} AS t_stat FROM sp1",
    _SPEARMAN_SQL))
def q_spearman(spark, sf):
    return rounded(corridors.corridor_spearman(corridors.corridor_stats(_features(spark, sf))))


@register("q_distance_trend", on_master(
    f"SELECT {R('regr_slope(sat_rate * 100, avg_distance)')} AS slope, "
    f"{R('regr_intercept(sat_rate * 100, avg_distance)')} AS intercept, {R('min(avg_distance)')} AS x_min, "
    f"{R('max(avg_distance)')} AS x_max, CAST(regr_count(sat_rate * 100, avg_distance) AS BIGINT) AS n FROM corr", _CORRIDOR_SQL))
def q_distance_trend(spark, sf):
    return rounded(corridors.distance_trend(corridors.corridor_stats(_features(spark, sf))))


@register("q_statistical_tests", on_master(
    "SELECT 'Mann-Whitney U (same vs cross-state)' AS Test, round(u1, 6) AS Statistic, "
    "'rank-biserial r=' || printf('%.4f', 1.0E0 - 2.0E0 * u1 / (n1 * n2)) AS Effect_Size FROM mw "
    "UNION ALL SELECT 'Spearman (corridor distance vs satisfaction)', round(rho, 6), "
    "'rho=' || printf('%.3f', rho) FROM sp1", _MW_SQL, _SPEARMAN_SQL))
def q_statistical_tests(spark, sf):
    return rounded(corridors.statistical_tests(_features(spark, sf), with_p=False))


# Tails by Simpson's rule over even steps: the normal density beyond |z|, and for
# Student's t the power of the cosine from atan(|t| / sqrt(dof)) to a right angle.
_P_SQL = """
mz AS (SELECT (u1 - n1 * n2 / 2.0E0 - 0.5E0) / sqrt(n1 * n2 / 12.0E0 * ((n1 + n2 + 1)
              - tie_term / ((n1 + n2) * (n1 + n2 - 1.0E0)))) AS z FROM mw),
steps AS (SELECT i, CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 3.0E0 AS w
          FROM range(0, 20001) t(i)),
ptail AS (SELECT sum(w * 0.001E0 * exp(-pow(abs(z) + i * 0.001E0, 2) / 2) / sqrt(2 * pi())) AS tail,
                 any_value(z) AS z FROM mz, steps),
pmw AS (SELECT CASE WHEN z >= 0 THEN tail ELSE 1 - tail END AS p FROM ptail),
tt AS (SELECT n - 2 AS dof, rho * sqrt((n - 2) / (1.0E0 - rho * rho)) AS t FROM sp1 WHERE n > 2),
tu AS (SELECT dof, t, atan(abs(t) / sqrt(dof)) AS u, (pi() / 2 - atan(abs(t) / sqrt(dof))) / 20000 AS h FROM tt),
psp AS (SELECT 2 * exp(lgamma((any_value(dof) + 1) / 2.0E0) - lgamma(any_value(dof) / 2.0E0)) / sqrt(pi())
               * sum(w * h * pow(greatest(cos(u + i * h), 0), dof - 1)) AS p FROM tu, steps)"""


@register("q_statistical_tests_p", on_master(
    "SELECT 'Mann-Whitney U (same vs cross-state)' AS Test, round(u1, 6) AS Statistic, "
    "(SELECT round(p, 6) FROM pmw) AS p_value, "
    "'rank-biserial r=' || printf('%.4f', 1.0E0 - 2.0E0 * u1 / (n1 * n2)) AS Effect_Size FROM mw "
    "UNION ALL SELECT 'Spearman (corridor distance vs satisfaction)', round(rho, 6), "
    "(SELECT round(p, 6) FROM psp), 'rho=' || printf('%.3f', rho) FROM sp1", _MW_SQL, _SPEARMAN_SQL, _P_SQL))
def q_statistical_tests_p(spark, sf):
    """The test table with p-values: normal and Student t tails of the one-row
    statistics."""
    return rounded(corridors.statistical_tests(_features(spark, sf), with_p=True))


@register("q_corridor_bubbles", on_master(
    f"SELECT corridor, {R('avg_distance')} AS x, {R('sat_rate * 100')} AS y, {R('n / 5.0E0')} AS size, "
    f"{R('late_rate')} AS colour FROM corr", _CORRIDOR_SQL))
def q_corridor_bubbles(spark, sf):
    return rounded(corridors.corridor_bubbles(corridors.corridor_stats(_features(spark, sf))))

# ============================================================ 2.5 split ==

@register("q_time_split", on_master(
    "SELECT order_id, review_score, order_purchase_timestamp, is_train FROM split"))
def q_time_split(spark, sf):
    return _labelled(spark, sf).select(*ROW_KEY, "order_purchase_timestamp", "is_train")


@register("q_split_drift", on_master(
    "SELECT count(*) FILTER (WHERE is_train = 1) AS train_rows, count(*) FILTER (WHERE is_train = 0) AS test_rows, "
    "min(order_purchase_timestamp) FILTER (WHERE is_train = 1) AS train_start, "
    "max(order_purchase_timestamp) FILTER (WHERE is_train = 1) AS train_end, "
    "min(order_purchase_timestamp) FILTER (WHERE is_train = 0) AS test_start, "
    "max(order_purchase_timestamp) FILTER (WHERE is_train = 0) AS test_end, "
    f"{R('avg(satisfied) FILTER (WHERE is_train = 1)')} AS train_rate, "
    f"{R('avg(satisfied) FILTER (WHERE is_train = 0)')} AS test_rate, "
    f"{R('avg(satisfied) FILTER (WHERE is_train = 0) - avg(satisfied) FILTER (WHERE is_train = 1)')} AS drift, "
    "CAST(abs(avg(satisfied) FILTER (WHERE is_train = 0) - avg(satisfied) FILTER (WHERE is_train = 1)) > 0.03E0 AS INTEGER) AS drift_flag "
    "FROM split"))
def q_split_drift(spark, sf):
    return rounded(split_summary(_labelled(spark, sf)))

# ===================================================== seller features ==

_SELLER_SQL = """
sstats AS (
  SELECT seller_id, CAST(count(order_id) AS DOUBLE) AS seller_order_count, avg(review_score) AS seller_avg_review,
         avg(is_late) AS seller_late_rate, avg(distance_km) AS seller_avg_distance
  FROM train WHERE seller_id IS NOT NULL GROUP BY seller_id),
train_j AS (SELECT t.*, s.seller_order_count, s.seller_avg_review, s.seller_late_rate, s.seller_avg_distance
            FROM train t LEFT JOIN sstats s ON t.seller_id = s.seller_id),
test_j AS (SELECT t.*, s.seller_order_count, s.seller_avg_review, s.seller_late_rate, s.seller_avg_distance
           FROM test t LEFT JOIN sstats s ON t.seller_id = s.seller_id),
smed AS (SELECT median(seller_order_count) AS m1, median(seller_avg_review) AS m2,
                median(seller_late_rate) AS m3, median(seller_avg_distance) AS m4 FROM train_j),
train_f AS (SELECT * REPLACE (coalesce(seller_order_count, (SELECT m1 FROM smed)) AS seller_order_count,
                              coalesce(seller_avg_review, (SELECT m2 FROM smed)) AS seller_avg_review,
                              coalesce(seller_late_rate, (SELECT m3 FROM smed)) AS seller_late_rate,
                              coalesce(seller_avg_distance, (SELECT m4 FROM smed)) AS seller_avg_distance) FROM train_j),
test_f AS (SELECT * REPLACE (coalesce(seller_order_count, (SELECT m1 FROM smed)) AS seller_order_count,
                             coalesce(seller_avg_review, (SELECT m2 FROM smed)) AS seller_avg_review,
                             coalesce(seller_late_rate, (SELECT m3 FROM smed)) AS seller_late_rate,
                             coalesce(seller_avg_distance, (SELECT m4 FROM smed)) AS seller_avg_distance) FROM test_j)"""

_SF_COLS = ", ".join(f"{R(c)} AS {c}" for c in sellers.SELLER_FEATURES)


@register("q_seller_stats", on_master(f"SELECT seller_id, {_SF_COLS} FROM sstats", _SELLER_SQL))
def q_seller_stats(spark, sf):
    train, _ = _train_test(spark, sf)
    return rounded(sellers.seller_stats(train))


@register("q_seller_features_train", on_master(
    f"SELECT order_id, review_score, seller_id, {_SF_COLS} FROM train_f", _SELLER_SQL))
def q_seller_features_train(spark, sf):
    train, test = _train_test(spark, sf)
    tr, _ = sellers.add_seller_features(train, test)
    return rounded(tr.select(*ROW_KEY, "seller_id", *sellers.SELLER_FEATURES))


@register("q_seller_features_test", on_master(
    f"SELECT order_id, review_score, seller_id, {_SF_COLS} FROM test_f", _SELLER_SQL))
def q_seller_features_test(spark, sf):
    train, test = _train_test(spark, sf)
    _, te = sellers.add_seller_features(train, test)
    return rounded(te.select(*ROW_KEY, "seller_id", *sellers.SELLER_FEATURES))


@register("q_cold_start_sellers", on_master(
    "SELECT (SELECT count(DISTINCT seller_id) FROM train) AS train_sellers, count(*) AS test_rows, "
    "count(*) FILTER (WHERE seller_id IN (SELECT seller_id FROM train WHERE seller_id IS NOT NULL)) AS seen_rows, "
    "count(*) FILTER (WHERE seller_id IS NULL OR seller_id NOT IN (SELECT seller_id FROM train WHERE seller_id IS NOT NULL)) AS unseen_rows "
    "FROM test"))
def q_cold_start_sellers(spark, sf):
    train, test = _train_test(spark, sf)
    return sellers.cold_start(train, test)

# ======================================================= seller segments ==

_SEG_SQL = """
sperf AS (
  SELECT seller_id, count(order_id) AS order_count, avg(review_score) AS avg_review, avg(satisfied) AS sat_rate,
         avg(is_late) AS late_rate, avg(distance_km) AS avg_distance, avg(actual_delivery_days) AS avg_delivery_days,
         avg(total_order_value) AS avg_order_value
  FROM feat WHERE seller_id IS NOT NULL GROUP BY seller_id HAVING count(order_id) >= 5),
seg AS (SELECT *, CAST(seller_id % 4 AS INTEGER) AS segment FROM sperf),
segm AS (SELECT segment, avg(avg_review) AS avg_review, avg(late_rate) AS late_rate, avg(order_count) AS order_count
         FROM seg GROUP BY segment),
segq AS (SELECT quantile_cont(avg_review, 0.7) AS r70, quantile_cont(late_rate, 0.3) AS l30,
                quantile_cont(late_rate, 0.7) AS l70, quantile_cont(order_count, 0.5) AS o50 FROM segm),
segb AS (SELECT segment, CASE WHEN avg_review >= r70 AND late_rate <= l30 THEN 'Top Performers'
                              WHEN late_rate >= l70 THEN 'At-Risk'
                              WHEN order_count >= o50 THEN 'High Volume' ELSE 'Developing' END AS base
         FROM segm, segq),
segn AS (SELECT segment, CASE WHEN rn = 1 THEN base ELSE base || ' (' || rn || ')' END AS segment_name
         FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY segment) AS rn FROM segb)),
named AS (SELECT seg.*, segn.segment_name FROM seg JOIN segn ON seg.segment = segn.segment),
profile AS (SELECT segment_name, count(seller_id) AS n, round_even(avg(avg_review), 3) AS avg_review,
                   round_even(avg(sat_rate), 3) AS sat_rate, round_even(avg(late_rate), 3) AS late_rate,
                   round_even(avg(order_count), 3) AS avg_orders, round_even(avg(avg_distance), 3) AS avg_distance
            FROM named GROUP BY segment_name)"""


def _seller_perf(spark, sf):
    return sellers.seller_performance(_features(spark, sf))


def _named_given(spark, sf):
    return sellers.name_sellers(sellers.given_segments(_seller_perf(spark, sf)))


_PERF_COLS = ["avg_review", "sat_rate", "late_rate", "avg_distance", "avg_delivery_days", "avg_order_value"]


@register("q_seller_performance", on_master(
    "SELECT seller_id, order_count, " + ", ".join(
        f"{R(c + ' + 1e-7', 4) if c == 'avg_order_value' else R(c)} AS {c}" for c in _PERF_COLS) + " FROM sperf",
    _SEG_SQL))
def q_seller_performance(spark, sf):
    # The last bits of a plain mean of amounts depend on the order of summation: it is
    # compared at four decimals, both sides off the exact halves that means of cents have.
    perf = _seller_perf(spark, sf).withColumn(
        "avg_order_value", F.round(F.col("avg_order_value") + F.lit(1e-7), 4))
    return rounded(perf)


_LOG_SQL = """
cmed AS (SELECT median(avg_review) AS m_avg_review, median(late_rate) AS m_late_rate, median(avg_distance) AS m_avg_distance,
                median(avg_delivery_days) AS m_avg_delivery_days, median(order_count) AS m_order_count,
                median(avg_order_value) AS m_avg_order_value FROM sperf)"""


@register("q_seller_features_log", on_master(
    "SELECT seller_id, "
    + ", ".join(
        (f"{R(f'ln(1 + coalesce(CAST({c} AS DOUBLE), m_{c}))')} AS {c}" if c in sellers.LOG_COLUMNS
         else f"{R(f'coalesce(CAST({c} AS DOUBLE), m_{c})')} AS {c}")
        for c in sellers.CLUSTER_COLUMNS)
    + " FROM sperf, cmed", _SEG_SQL, _LOG_SQL))
def q_seller_features_log(spark, sf):
    return rounded(sellers.clustering_inputs(_seller_perf(spark, sf)))


@register("q_segment_names_given", on_master(
    "SELECT seller_id, segment, segment_name FROM named", _SEG_SQL))
def q_segment_names_given(spark, sf):
    return _named_given(spark, sf).select("seller_id", "segment", "segment_name")


@register("q_segment_profile", on_master(
    "SELECT segment_name, n, " + ", ".join(f"{R(c)} AS {c}" for c in
                                            ["avg_review", "sat_rate", "late_rate", "avg_orders", "avg_distance"])
    + " FROM profile", _SEG_SQL))
def q_segment_profile(spark, sf):
    return rounded(sellers.segment_profile(_named_given(spark, sf)))


_RADAR_SQL = """
radar_m AS (SELECT segment_name, avg(avg_review) AS avg_review, avg(sat_rate) AS sat_rate, avg(late_rate) AS late_rate,
                   avg(avg_distance) AS avg_distance, avg(avg_delivery_days) AS avg_delivery_days,
                   avg(order_count) AS order_count FROM named GROUP BY segment_name)"""


def _radar_sql_col(c: str) -> str:
    norm = (f"CASE WHEN max({c}) OVER () - min({c}) OVER () <> 0 THEN "
            f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END")
    expr = f"1.0E0 - ({norm})" if c in sellers.RADAR_INVERTED else norm
    return f"{R(expr)} AS {c}"


@register("q_segment_radar", on_master(
    "SELECT segment_name, " + ", ".join(_radar_sql_col(c) for c in sellers.RADAR_COLUMNS) + " FROM radar_m",
    _SEG_SQL, _RADAR_SQL))
def q_segment_radar(spark, sf):
    return rounded(sellers.segment_radar(_named_given(spark, sf)))


@register("q_recommendations_given", on_master(
    "SELECT segment_name AS Segment, n AS Sellers, printf('%.1f%%', sat_rate * 100) AS Satisfaction, "
    "printf('%.1f%%', late_rate * 100) AS Late_Rate, "
    "CASE WHEN sat_rate > 0.8 AND late_rate < 0.1 THEN 'Reward: featured placement, reduced commission' "
    "WHEN late_rate > 0.15 THEN 'Improve: logistics support, delivery monitoring' "
    "WHEN sat_rate < (SELECT quantile_cont(sat_rate, 0.5) FROM profile) THEN 'Support: quality guidelines, feedback loops' "
    "ELSE 'Maintain: standard monitoring, periodic review' END AS Strategy FROM profile", _SEG_SQL))
def q_recommendations_given(spark, sf):
    return sellers.recommendations(sellers.segment_profile(_named_given(spark, sf)))


@register("q_seller_scatter", on_master(
    f"SELECT seller_id, segment_name, {R('late_rate * 100')} AS late_pct, {R('sat_rate * 100')} AS sat_pct, "
    f"{R('order_count * 0.5E0')} AS size FROM named", _SEG_SQL))
def q_seller_scatter(spark, sf):
    return rounded(sellers.seller_scatter(_named_given(spark, sf)))

# ===================================================== 2.7 ML on frames ==


_FEATS = pr.FEATURE_COLUMNS


def _seller_featured(spark, sf):
    train, test = _train_test(spark, sf)
    return sellers.add_seller_features(train, test)


def _imputed(spark, sf):
    tr, te = _seller_featured(spark, sf)
    tr = pr.as_features(tr, _FEATS, ROW_KEY)
    te = pr.as_features(te, _FEATS, ROW_KEY)
    return pr.impute_medians(tr, te, _FEATS)


_IMPUTE_SQL = ("fmed AS (SELECT " + ", ".join(f"median(CAST({c} AS DOUBLE)) AS m_{c}" for c in _FEATS)
               + " FROM train_f)")
_FILLED_COLS = ", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}) AS {c}" for c in _FEATS)
_FILLED_SQL = f"""
xtrain AS (SELECT order_id, review_score, {_FILLED_COLS}, satisfied FROM train_f, fmed),
xtest AS (SELECT order_id, review_score, {_FILLED_COLS}, satisfied FROM test_f, fmed)"""


@register("q_impute_median", on_master(
    " UNION ALL ".join(f"SELECT '{c}' AS feature, {R(f'm_{c}')} AS median FROM fmed" for c in _FEATS),
    _SELLER_SQL, _IMPUTE_SQL))
def q_impute_median(spark, sf):
    _, _, meds = _imputed(spark, sf)
    pairs = [x for c in _FEATS for x in (F.lit(c), F.col(c))]
    return rounded(meds.select(F.stack(F.lit(len(_FEATS)), *pairs).alias("feature", "median")))


@register("q_sketch_medians", on_master(
    " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, true AS within FROM train_f" for c in _FEATS),
    _SELLER_SQL))
def q_sketch_medians(spark, sf):
    """Approximate medians (rank error 0.01) and whether their ranks hold to it."""
    tr, _ = _seller_featured(spark, sf)
    tr = cut_lineage(pr.as_features(tr, _FEATS))
    med = medians_row(tr, _FEATS, rank_error=0.01).first()
    counted = tr.agg(*[F.struct(F.count(c).alias("n"), F.count(F.when(F.col(c) < med[c], 1)).alias("below"),
                                F.count(F.when(F.col(c) <= med[c], 1)).alias("upto")).alias(c) for c in _FEATS])
    rows = counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in _FEATS])).alias("m"))
    n = F.col("m.r.n")
    return rows.select("m.feature", n.alias("n"),
                       ((F.col("m.r.below") <= 0.51 * n) & (F.col("m.r.upto") >= 0.49 * n)).alias("within"))


@register("q_feature_matrix", on_master(
    "SELECT order_id, review_score, 1 AS is_train, " + ", ".join(f"{R(c)} AS {c}" for c in _FEATS)
    + ", satisfied FROM xtrain UNION ALL SELECT order_id, review_score, 0, "
    + ", ".join(f"{R(c)}" for c in _FEATS) + ", satisfied FROM xtest",
    _SELLER_SQL, _IMPUTE_SQL, _FILLED_SQL))
def q_feature_matrix(spark, sf):
    tr, te, _ = _imputed(spark, sf)
    both = tr.withColumn("is_train", F.lit(1)).unionByName(te.withColumn("is_train", F.lit(0)))
    return rounded(both.select(*ROW_KEY, "is_train", *_FEATS, pr.LABEL))


@register("q_standardize", on_master(
    " UNION ALL ".join(f"SELECT '{c}' AS feature, {R(f'avg({c})')} AS mean, {R(f'stddev_pop({c})')} AS std "
                       "FROM xtrain" for c in _FEATS),
    _SELLER_SQL, _IMPUTE_SQL, _FILLED_SQL))
def q_standardize(spark, sf):
    tr, _, _ = _imputed(spark, sf)
    st = pr.scaler_stats(tr, _FEATS)
    rows = [(c, st[f"m_{c}"], st[f"s_{c}"]) for c in _FEATS]
    # 20 feature rows of moments computed by one aggregate over train
    return rounded(spark.createDataFrame(rows, "feature string, mean double, std double"))


_SCALED_SQL = "smom AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _FEATS) + " FROM xtrain)"


@register("q_scaled_features", on_master(
    "SELECT order_id, review_score, " + ", ".join(
        f"{R(f'({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END', 5)} AS {c}" for c in _FEATS)
    + " FROM xtest, smom", _SELLER_SQL, _IMPUTE_SQL, _FILLED_SQL, _SCALED_SQL))
def q_scaled_features(spark, sf):
    """Test features scaled by the training moments."""
    tr, te, _ = _imputed(spark, sf)
    scaled = pr.standardize(te, _FEATS, pr.scaler_stats(tr, _FEATS))
    return rounded(scaled.select(*ROW_KEY, *_FEATS), 5)


_EVAL_SQL = """
ev AS (SELECT order_id, review_score, satisfied AS label, 0.0E0 - coalesce(delivery_delay_days, 0.0E0) AS score,
              CAST(0.0E0 - coalesce(delivery_delay_days, 0.0E0) >= 0 AS INTEGER) AS prediction FROM test),
evc AS (SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
               count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
               count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
               count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM ev),
evm AS (SELECT *, coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0,
               coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1,
               CAST(tn + fp AS DOUBLE) AS s0, CAST(fn + tp AS DOUBLE) AS s1 FROM evc),
evf AS (SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1,
               s0 + s1 AS n FROM evm)"""


@register("q_confusion_matrix", on_master(
    "SELECT 0 AS actual, 0 AS predicted, tn AS n FROM evc UNION ALL SELECT 0, 1, fp FROM evc "
    "UNION ALL SELECT 1, 0, fn FROM evc UNION ALL SELECT 1, 1, tp FROM evc", _SELLER_SQL, _EVAL_SQL))
def q_confusion_matrix(spark, sf):
    _, test = _train_test(spark, sf)
    return ev.confusion_matrix(pr.given_scores(test))


@register("q_classification_report", on_master(
    f"SELECT '0' AS class_label, {R('p0')} AS precision, {R('r0')} AS recall, {R('f0')} AS f1_score, CAST(s0 AS BIGINT) AS support FROM evf "
    f"UNION ALL SELECT '1', {R('p1')}, {R('r1')}, {R('f1')}, CAST(s1 AS BIGINT) FROM evf "
    f"UNION ALL SELECT 'accuracy', NULL, NULL, {R('(tp + tn) / n')}, CAST(n AS BIGINT) FROM evf "
    f"UNION ALL SELECT 'macro avg', {R('(p0 + p1) / 2')}, {R('(r0 + r1) / 2')}, {R('(f0 + f1) / 2')}, CAST(n AS BIGINT) FROM evf "
    f"UNION ALL SELECT 'weighted avg', {R('(p0 * s0 + p1 * s1) / n')}, {R('(r0 * s0 + r1 * s1) / n')}, "
    f"{R('(f0 * s0 + f1 * s1) / n')}, CAST(n AS BIGINT) FROM evf", _SELLER_SQL, _EVAL_SQL))
def q_classification_report(spark, sf):
    _, test = _train_test(spark, sf)
    return rounded(ev.classification_report(pr.given_scores(test)))


_AUC_SQL = """
auc_h AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
          FROM ev GROUP BY score),
auc_c AS (SELECT *, sum(neg) OVER (ORDER BY score) - neg AS below FROM auc_h)"""


@register("q_auc", on_master(
    f"SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, "
    f"{R('sum(pos * (below + neg / 2.0E0)) / (sum(pos) * sum(neg))')} AS auc FROM auc_c",
    _SELLER_SQL, _EVAL_SQL, _AUC_SQL))
def q_auc(spark, sf):
    _, test = _train_test(spark, sf)
    return rounded(ev.auc(pr.given_scores(test)))


_ROC_SQL = """
roc_c AS (SELECT score AS threshold, pos, neg,
                 sum(pos) OVER (ORDER BY score DESC) AS tps, sum(neg) OVER (ORDER BY score DESC) AS fps,
                 row_number() OVER (ORDER BY score DESC) AS idx,
                 lead(pos) OVER (ORDER BY score DESC) AS npos, lead(neg) OVER (ORDER BY score DESC) AS nneg
          FROM auc_h),
roc_t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM auc_h)"""


@register("q_roc_curve", on_master(
    "SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0E0 AS fpr, 0.0E0 AS tpr "
    f"UNION ALL SELECT {R('threshold')}, {R('fps / N')}, {R('tps / P')} FROM roc_c, roc_t "
    "WHERE idx = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg",
    _SELLER_SQL, _EVAL_SQL, _AUC_SQL, _ROC_SQL))
def q_roc_curve(spark, sf):
    _, test = _train_test(spark, sf)
    return rounded(ev.roc_curve(pr.given_scores(test)))

# ------------------------------------------------ pairwise / clustering --



def _embeddings(spark, sf):
    import os
    return spark.read.parquet(os.path.join(sf, "embeddings.parquet"))


_EMB_SQL = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@register("q_knn", with_ctes(_EMB_SQL, """
d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_distance(a.v, b.v) AS distance
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS neighbor_rank FROM d)""",
    body="SELECT query_id, CAST(neighbor_rank AS INTEGER) AS neighbor_rank, neighbor_id, "
         "round(distance, 6) AS distance FROM r WHERE neighbor_rank <= 5"))
def q_knn(spark, sf):
    e = _embeddings(spark, sf)
    return rounded(knn(e, e, "vec_id", "embedding", k=5))


@register("q_silhouette", with_ctes(_EMB_SQL, """
d AS (SELECT a.vec_id AS id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS dist_sum, count(*) AS n_other
      FROM e a JOIN e b ON true GROUP BY 1, 2, 3),
per AS (SELECT id, max(CASE WHEN label = other THEN dist_sum END) AS own_sum,
               max(CASE WHEN label = other THEN n_other END) AS own_n,
               min(CASE WHEN label <> other THEN dist_sum / n_other END) AS b FROM d GROUP BY id),
s AS (SELECT CASE WHEN own_n <= 1 THEN 0.0E0 ELSE coalesce((b - own_sum / (own_n - 1)) /
             greatest(own_sum / (own_n - 1), b), 0.0E0) END AS s FROM per)""",
    body="SELECT count(*) AS n, round(avg(s), 6) AS silhouette FROM s"))
def q_silhouette(spark, sf):
    e = _embeddings(spark, sf)
    return rounded(silhouette_score(e, "vec_id", "embedding", "label"))


_FOLD_KEY = "pmod(order_id * 7919 + review_score * 104729, 1000003)"


@register("q_stratified_folds", on_master(
    "SELECT order_id, review_score, satisfied, CAST((row_number() OVER (PARTITION BY satisfied "
    "ORDER BY (order_id * 7919 + review_score * 104729) % 1000003, order_id, review_score) - 1) % 5 AS INTEGER) "
    "AS fold FROM train"))
def q_stratified_folds(spark, sf):
    train, _ = _train_test(spark, sf)
    keyed = train.select(*ROW_KEY, "satisfied", F.expr(_FOLD_KEY).alias("_key"))
    return stratified_folds(keyed, "satisfied", "_key", ROW_KEY, 5).select(*ROW_KEY, "satisfied", "fold")


def _model_data(spark, sf):
    """Train/test with seller features, top-5 category dummies, row ids and
    train-median imputation (all statistics from train)."""
    master = build_master(_tables(spark, sf))
    feat = engineer_features(master, None)
    # written, so that the ids stay as they are in every later pass
    lab = save_table(chronological_split(feat).withColumn("row_id", F.monotonically_increasing_id()))
    train = lab.filter(F.col("is_train") == 1).drop("is_train")
    test = lab.filter(F.col("is_train") == 0).drop("is_train")
    tr, te = sellers.add_seller_features(train, test)
    cols = pr.feature_columns(tr)
    tr = pr.as_features(tr, cols, ["row_id", *ROW_KEY])
    te = pr.as_features(te, cols, ["row_id", *ROW_KEY])
    tr, te, _ = pr.impute_medians(save_table(tr), te, cols)
    return tr, te, cols


@register("q_smote")
def q_smote(spark, sf):
    oversampled, _, _ = _smoted(spark, sf)
    return oversampled


def _smoted(spark, sf):
    tr, te, cols = _model_data(spark, sf)
    return cut_lineage(smote(tr, "row_id", cols, pr.LABEL, k=5, seed=42)), cut_lineage(te), cols


_V = "[" + ", ".join(_FEATS) + "]"
_DRAWS = draws_sql("s", "(SELECT n_min FROM sm_n)", 5, 42)
# rows of the minority, their five nearest others, and the synthetic rows drawn from them
_SMOTE_SQL = f"""
sm_x AS (SELECT *, row_number() OVER (ORDER BY order_id, review_score) - 1 AS row_id FROM xtrain),
sm_c AS (SELECT satisfied, count(*) AS n FROM sm_x GROUP BY satisfied),
sm_n AS (SELECT arg_min(satisfied, n * 10 + satisfied) AS minority, min(n) AS n_min, max(n) - min(n) AS need FROM sm_c),
sm_m AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS position, {_V} AS v FROM sm_x, sm_n
         WHERE satisfied = minority),
sm_k AS (SELECT a.position, a.v AS x, b.v AS y,
                row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.v, b.v), b.row_id) AS neighbor_rank
         FROM sm_m a JOIN sm_m b ON a.row_id <> b.row_id),
sm_s AS (SELECT unnest(range(0, (SELECT need FROM sm_n))) AS s),
sm_d AS (SELECT {", ".join(f"{v} AS {k}" for k, v in _DRAWS.items())} FROM sm_s),
sm_new AS (SELECT {", ".join(f"x[{i + 1}] + gap * (y[{i + 1}] - x[{i + 1}]) AS {c}" for i, c in enumerate(_FEATS))},
                  minority AS satisfied, 1 AS synthetic
           FROM sm_d JOIN sm_k USING (position, neighbor_rank), sm_n),
sm_all AS (SELECT {", ".join(_FEATS)}, satisfied, 0 AS synthetic FROM sm_x UNION ALL SELECT * FROM sm_new)"""


def _smoted_fixed(spark, sf):
    """Train (oversampled) and test with the 20 named features; rows are numbered
    by order and score, so that SQL can draw the same ones."""
    tr, te, _ = _imputed(spark, sf)
    tr = save_table(tr)
    tr = cut_lineage(dense_positions(tr.withColumn("_one", F.lit(0)), "_one", "order_id", ["review_score"])
                     .withColumnRenamed("position", "row_id").drop("_one"))
    return cut_lineage(smote(tr, "row_id", _FEATS, pr.LABEL, k=5, seed=42, order_col="row_id")), te


@register("q_smote_synthetic", on_master(
    "SELECT " + ", ".join(f"{R(c, 5)} AS {c}" for c in _FEATS) + ", satisfied, synthetic FROM sm_all",
    _SELLER_SQL, _IMPUTE_SQL, _FILLED_SQL, _SMOTE_SQL))
def q_smote_synthetic(spark, sf):
    """The oversampled training set of the named features."""
    return rounded(_smoted_fixed(spark, sf)[0], 5)


_MOMENT_SQL = "lm AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _FEATS) \
    + " FROM sm_all)"


@register("q_logistic_optimum", on_master(
    f"SELECT '(intercept)' AS feature, {R('avg(CAST(satisfied AS DOUBLE))', 5)} AS observed, "
    f"{R('avg(CAST(satisfied AS DOUBLE))', 5)} AS fitted FROM sm_all"
    + "".join(f" UNION ALL SELECT '{c}', {v}, {v} FROM sm_all, lm" for c, v in (
        (c, R(f"avg(satisfied * ({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END)", 5)) for c in _FEATS)),
    _SELLER_SQL, _IMPUTE_SQL, _FILLED_SQL, _SMOTE_SQL, _MOMENT_SQL))
def q_logistic_optimum(spark, sf):
    """Certificate of the logistic fit: fitted moments are the observed ones to
    1e-5. A fitted value that is further off shows as it is."""
    tr, _ = _smoted_fixed(spark, sf)
    model, stats = pr.fit_logistic(tr, _FEATS)
    out = rounded(pr.logistic_moments(model, stats, tr, _FEATS).withColumn(
        "fitted", F.when(F.abs(F.col("fitted") - F.col("observed")) < 1e-5, F.col("observed"))
        .otherwise(F.col("fitted"))), 5)
    return out.select("feature", *[F.when(F.col(c) == 0, 0.0).otherwise(F.col(c)).alias(c) for c in ("observed", "fitted")])


_GIVEN_WEIGHTS = {"delivery_delay_days": -2.0, "carrier_handling_days": -1.0, "freight_ratio": 30.0}
_REPEATS = 4


def _given_score(shuffled: str | None) -> str:
    return "0.0E0" + "".join(f" + {'d' if c == shuffled else 'a'}.{c} * {w:.1f}E0" for c, w in _GIVEN_WEIGHTS.items())


_PERM_SQL = f"""
pm AS (SELECT row_number() OVER (ORDER BY order_id, review_score) - 1 AS id, count(*) OVER () AS n,
              {", ".join(_GIVEN_WEIGHTS)}, satisfied AS label FROM xtest),
pm_r AS (SELECT unnest(range(0, {_REPEATS})) AS r),
pm_s AS (SELECT '' AS feature, 0 AS r, a.label, {_given_score(None)} AS score FROM pm a
  {"".join(f"UNION ALL SELECT '{c}', r, a.label, {_given_score(c)} FROM pm a, pm_r, pm d "
           "WHERE d.id = (a.id + 1 + (r * 7919 + 42) % greatest(1, a.n - 1)) % a.n " for c in _GIVEN_WEIGHTS)}),
pm_h AS (SELECT feature, r, score, sum(label) AS pos, sum(1 - label) AS neg FROM pm_s GROUP BY feature, r, score),
pm_c AS (SELECT *, sum(neg) OVER (PARTITION BY feature, r ORDER BY score) - neg AS below FROM pm_h),
pm_a AS (SELECT feature, r, sum(pos * (below + neg / 2.0E0)) / (sum(pos) * sum(neg)) AS auc FROM pm_c GROUP BY feature, r)"""


@register("q_permutation_given", on_master(
    f"SELECT feature, {R('avg(b.auc - p.auc)')} AS permutation_importance, "
    f"{R('stddev_pop(b.auc - p.auc)')} AS permutation_std FROM pm_a p, (SELECT auc FROM pm_a WHERE feature = '') b "
    "WHERE feature <> '' GROUP BY feature", _SELLER_SQL, _IMPUTE_SQL, _FILLED_SQL, _PERM_SQL))
def q_permutation_given(spark, sf):
    """Permutation importance of a fixed scorer, rows turned by arithmetic."""
    _, te, _ = _imputed(spark, sf)
    te = cut_lineage(dense_positions(te.withColumn("_one", F.lit(0)), "_one", "order_id", ["review_score"]))
    return rounded(pr.permutation_importance(
        pr.LinearScorer(_GIVEN_WEIGHTS), te, list(_GIVEN_WEIGHTS), "position", n_repeats=_REPEATS, seed=42,
        permutation=pr.shifted_donors))


@register("q_logistic")
def q_logistic(spark, sf):
    tr, te, cols = _smoted(spark, sf)
    model, stats = pr.fit_logistic(tr, cols)
    return pr.predict(model, te, cols, stats)


def _boosted(spark, sf):
    """The search of the whole space (20 draws, 5 folds); run once for these
    three queries, since it is saved under the name of its data."""
    tr, te, cols = _smoted(spark, sf)
    return pr.tune_boosted(tr, cols)[1], te, cols


@register("q_gbt")
def q_gbt(spark, sf):
    model, te, cols = _boosted(spark, sf)
    return pr.predict(model, te, cols)


@register("q_importance")
def q_importance(spark, sf):
    model, te, cols = _boosted(spark, sf)
    perm = pr.permutation_importance(model, te, cols, "row_id", n_repeats=10, seed=42)
    return (model.gains().join(perm, "feature", "left")
            .orderBy(F.desc("permutation_importance"), "feature"))


@register("q_model_comparison")
def q_model_comparison(spark, sf):
    tr, te, cols = _smoted(spark, sf)
    lr, stats = pr.fit_logistic(tr, cols)
    m1 = ev.model_metrics(pr.predict(lr, te, cols, stats), "Logistic Regression")
    m2 = ev.model_metrics(pr.predict(pr.tune_boosted(tr, cols)[1], te, cols), "Gradient-Boosted Trees")
    return ev.comparison_table(m1.unionByName(m2))


@register("q_kmeans")
def q_kmeans(spark, sf):
    perf = cut_lineage(_seller_perf(spark, sf))  # one row a seller, read some ten times
    x = sellers.clustering_inputs(perf)
    stats = pr.scaler_stats(x, sellers.CLUSTER_COLUMNS)
    vec = cl.assemble(pr.standardize(x, sellers.CLUSTER_COLUMNS, stats), sellers.CLUSTER_COLUMNS)
    # ~70 iterative fits read this table: materialise it once
    vec = cut_lineage(vec.select("seller_id", "features"))
    k, _ = cl.choose_k(vec, "seller_id", "features", range(2, 7), n_init=10, seed=42)
    model, _ = cl.kmeans_restarts(vec, "features", k, n_init=20, seed=42)
    seg = model.transform(vec).select("seller_id", F.col("prediction").alias("segment"))
    labelled = perf.join(seg, "seller_id")
    labelled = cl.renumber_by(labelled, "segment", [("avg_review", True), ("late_rate", False)])
    named = sellers.name_sellers(labelled)
    return named.select("seller_id", "segment", "segment_name")


_CLUSTER_VALUE = {c: (f"ln(1 + coalesce(CAST({c} AS DOUBLE), m_{c}))" if c in sellers.LOG_COLUMNS
                      else f"coalesce(CAST({c} AS DOUBLE), m_{c})") for c in sellers.CLUSTER_COLUMNS}


@register("q_kmeans_fixed_point", on_master(
    "SELECT CAST(k AS INTEGER) AS k, count(*) AS n, CAST(0 AS BIGINT) AS misplaced, "
    + R("sum(" + " + ".join(f"pow((x_{c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END, 2)"
                            for c in sellers.CLUSTER_COLUMNS) + ")", 5)
    + " AS total_ss, true AS cost_is_sum FROM kx, km, (SELECT unnest(range(2, 7)) AS k) GROUP BY k",
    _SEG_SQL, _LOG_SQL,
    "kx AS (SELECT " + ", ".join(f"{v} AS x_{c}" for c, v in _CLUSTER_VALUE.items()) + " FROM sperf, cmed)",
    "km AS (SELECT " + ", ".join(f"avg(x_{c}) AS m_{c}, stddev_pop(x_{c}) AS s_{c}" for c in sellers.CLUSTER_COLUMNS)
    + " FROM kx)"))
def q_kmeans_fixed_point(spark, sf):
    """Certificate of each K-Means run: every seller at its nearest centre, every
    centre the mean of its sellers, the cost the sum of the squares within."""
    x = sellers.clustering_inputs(cut_lineage(_seller_perf(spark, sf)))
    stats = pr.scaler_stats(x, sellers.CLUSTER_COLUMNS)
    vec = cl.assemble(pr.standardize(x, sellers.CLUSTER_COLUMNS, stats), sellers.CLUSTER_COLUMNS)
    vec = cut_lineage(vec.select("seller_id", "features"))
    out = None
    for k in range(2, 7):
        model, _ = cl.kmeans_restarts(vec, "features", k, n_init=5, seed=42, tol=0.0)
        row = cl.fixed_point(vec, "seller_id", "features", model).select(F.lit(k).alias("k"), "*")
        out = row if out is None else out.unionByName(row)
    return rounded(out, 5)
