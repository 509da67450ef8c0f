"""DuckDB SQL text of the correctness oracle.

Each registered query has an equivalent SQL statement over the driver's
pre-registered parquet views. The statements share CTE blocks: the
commerce-shaped fixture views (FIXTURES.md §5), the master table and its
features. Floats are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

FIXTURE_CTES = """
c_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
    CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'canceled' END AS order_status,
    o_orderdate + to_seconds(CAST((o_orderkey*7919)%86400 AS INTEGER)) AS order_purchase_timestamp,
    o_orderdate + to_seconds(CAST((o_orderkey*7919)%86400+3600 AS INTEGER)) AS order_approved_at,
    CASE WHEN o_orderkey%83=0 THEN NULL ELSE o_orderdate + to_seconds(CAST((o_orderkey*7919)%86400+86400*(1+o_orderkey%4) AS INTEGER)) END AS order_delivered_carrier_date,
    CASE WHEN o_orderkey%97=0 THEN NULL ELSE o_orderdate + to_seconds(CAST((o_orderkey*7919)%86400+3600*(48+(o_orderkey*13)%700) AS INTEGER)) END AS order_delivered_customer_date,
    CASE WHEN o_orderkey%89=0 THEN NULL ELSE o_orderdate + to_seconds(CAST((o_orderkey*7919)%86400+86400*(20+o_orderkey%17) AS INTEGER)) END AS order_estimated_delivery_date
  FROM orders),
c_reviews AS (
  SELECT o_orderkey AS order_id,
    CASE WHEN 48+(o_orderkey*13)%700 > 24*(20+o_orderkey%17) THEN 1+(o_orderkey*31)%4
         WHEN (o_orderkey*31)%10 < 1 THEN 3 ELSE 4+o_orderkey%2 END AS review_score
  FROM orders WHERE o_orderkey%50<>7
  UNION ALL SELECT o_orderkey, 1+(o_orderkey*31)%5 FROM orders WHERE o_orderkey%40=0),
c_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
    CASE WHEN l_orderkey%113=0 THEN 0.0E0 ELSE l_extendedprice END AS price,
    CASE WHEN l_orderkey%113=0 THEN 0.0E0 ELSE l_extendedprice*l_tax END AS freight_value
  FROM lineitem),
c_payments AS (
  SELECT o_orderkey AS order_id, s AS payment_sequential,
    CASE (o_orderkey+s)%4 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'boleto' WHEN 2 THEN 'debit_card' ELSE 'voucher' END AS payment_type,
    1+(o_orderkey+3*s)%10 AS payment_installments
  FROM orders CROSS JOIN (SELECT 1 AS s UNION ALL SELECT 2 UNION ALL SELECT 3) q
  WHERE s <= 1+o_orderkey%3 AND o_orderkey%71<>0),
c_products AS (
  SELECT p_partkey AS product_id, CASE WHEN p_partkey%29=0 THEN NULL ELSE lower(p_type) END AS product_category_name,
    CASE WHEN p_partkey%31=0 THEN NULL ELSE p_size*100.0E0 END AS product_weight_g
  FROM part),
c_categories AS (
  SELECT DISTINCT lower(p_type) AS product_category_name, concat('cat ', lower(p_type)) AS product_category_name_english
  FROM part WHERE p_type <> 'PROMO'),
c_customers AS (
  SELECT c_custkey AS customer_id, r_name AS customer_state, c_nationkey*10+c_custkey%10 AS customer_zip_code_prefix
  FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey),
c_sellers AS (
  SELECT s_suppkey AS seller_id, r_name AS seller_state, s_nationkey*10+s_suppkey%10 AS seller_zip_code_prefix
  FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE s_suppkey%53<>5),
c_geo AS (
  SELECT zip AS geolocation_zip_code_prefix,
    -25.0E0 + 1.5E0*((zip%50)/10.0E0) + 0.01E0*(k%7) AS geolocation_lat,
    -55.0E0 + 0.4E0*(zip%25) + 0.01E0*(k%5) AS geolocation_lng
  FROM (SELECT c_nationkey*10+c_custkey%10 AS zip, c_custkey AS k FROM customer
        UNION ALL SELECT s_nationkey*10+s_suppkey%10, s_suppkey FROM supplier) g
  WHERE zip%41<>0)"""

MASTER_CTES = """
d_orders AS (
  SELECT * FROM c_orders WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL),
items_sum AS (
  SELECT order_id,
    min({'a': order_item_id, 'b': product_id, 'c': seller_id}) FILTER (WHERE seller_id IS NOT NULL).c AS seller_id,
    min({'a': order_item_id, 'b': product_id, 'c': seller_id}).b AS product_id,
    coalesce(sum(price), 0.0E0) AS total_price,
    coalesce(sum(freight_value), 0.0E0) AS total_freight,
    count(order_item_id) AS num_items
  FROM c_items GROUP BY order_id),
items_agg AS (
  SELECT order_id, seller_id, product_id, total_price, total_freight, num_items,
    total_price + total_freight AS total_order_value,
    coalesce(CASE WHEN total_price + total_freight <> 0 THEN total_freight / (total_price + total_freight) END, 0.0E0) AS freight_ratio
  FROM items_sum),
pay_type_n AS (
  SELECT order_id, payment_type, count(*) AS n FROM c_payments WHERE payment_type IS NOT NULL GROUP BY order_id, payment_type),
pay_mode AS (
  SELECT order_id, payment_type AS primary_payment_type FROM (
    SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY n DESC, payment_type) AS rn FROM pay_type_n) WHERE rn = 1),
pay_agg AS (
  SELECT p.order_id, max(p.payment_installments) AS payment_installments, any_value(m.primary_payment_type) AS primary_payment_type
  FROM c_payments p LEFT JOIN pay_mode m ON p.order_id = m.order_id GROUP BY p.order_id),
prod AS (
  SELECT p.product_id, c.product_category_name_english, p.product_weight_g
  FROM c_products p LEFT JOIN c_categories c ON p.product_category_name = c.product_category_name),
geo AS (
  SELECT geolocation_zip_code_prefix, median(geolocation_lat) AS lat, median(geolocation_lng) AS lng
  FROM c_geo WHERE geolocation_zip_code_prefix IS NOT NULL GROUP BY geolocation_zip_code_prefix),
master0 AS (
  SELECT o.order_id, o.customer_id, o.order_status, o.order_purchase_timestamp, o.order_approved_at,
    o.order_delivered_carrier_date, o.order_delivered_customer_date, o.order_estimated_delivery_date,
    r.review_score, i.seller_id, i.total_price, i.total_freight, i.num_items, i.total_order_value,
    i.freight_ratio, pa.payment_installments, pa.primary_payment_type,
    pr.product_category_name_english, pr.product_weight_g,
    cu.customer_state, cu.customer_zip_code_prefix, se.seller_state, se.seller_zip_code_prefix,
    gc.lat AS cust_lat, gc.lng AS cust_lng, gs.lat AS sell_lat, gs.lng AS sell_lng
  FROM d_orders o
  JOIN c_reviews r ON o.order_id = r.order_id
  LEFT JOIN items_agg i ON o.order_id = i.order_id
  LEFT JOIN pay_agg pa ON o.order_id = pa.order_id
  LEFT JOIN prod pr ON i.product_id = pr.product_id
  LEFT JOIN c_customers cu ON o.customer_id = cu.customer_id
  LEFT JOIN c_sellers se ON i.seller_id = se.seller_id
  LEFT JOIN geo gc ON cu.customer_zip_code_prefix = gc.geolocation_zip_code_prefix
  LEFT JOIN geo gs ON se.seller_zip_code_prefix = gs.geolocation_zip_code_prefix),
master AS (
  SELECT *,
    CASE WHEN cust_lat IS NOT NULL AND cust_lng IS NOT NULL AND sell_lat IS NOT NULL AND sell_lng IS NOT NULL THEN
      2 * 6371.0E0 * asin(sqrt(least(1.0E0,
        pow(sin((radians(sell_lat) - radians(cust_lat)) / 2), 2)
        + cos(radians(cust_lat)) * cos(radians(sell_lat)) * pow(sin((radians(sell_lng) - radians(cust_lng)) / 2), 2))))
    END AS distance_km
  FROM master0),
timed AS (
  SELECT *,
    (epoch_us(order_delivered_customer_date) - epoch_us(order_purchase_timestamp)) / 86400e6 AS actual_delivery_days,
    (epoch_us(order_estimated_delivery_date) - epoch_us(order_purchase_timestamp)) / 86400e6 AS estimated_delivery_days,
    (epoch_us(order_delivered_carrier_date) - epoch_us(order_purchase_timestamp)) / 86400e6 AS carrier_handling_days
  FROM master),
feat AS (
  SELECT *,
    actual_delivery_days - estimated_delivery_days AS delivery_delay_days,
    CAST(coalesce(actual_delivery_days - estimated_delivery_days > 0, false) AS INTEGER) AS is_late,
    seller_state || ' -> ' || customer_state AS corridor,
    CAST(coalesce(customer_state = seller_state, false) AS INTEGER) AS same_state,
    CASE WHEN distance_km > 0 AND distance_km <= 100 THEN '<100km'
         WHEN distance_km > 100 AND distance_km <= 500 THEN '100-500km'
         WHEN distance_km > 500 AND distance_km <= 1000 THEN '500-1000km'
         WHEN distance_km > 1000 THEN '>1000km' END AS distance_band,
    CAST(coalesce(primary_payment_type = 'credit_card', false) AS INTEGER) AS pay_credit_card,
    CAST(coalesce(primary_payment_type = 'boleto', false) AS INTEGER) AS pay_boleto,
    CAST(coalesce(primary_payment_type = 'debit_card', false) AS INTEGER) AS pay_debit_card,
    CAST(month(order_purchase_timestamp) AS INTEGER) AS purchase_month,
    CAST(isodow(order_purchase_timestamp) - 1 AS INTEGER) AS purchase_dow,
    CAST(hour(order_purchase_timestamp) AS INTEGER) AS purchase_hour,
    CAST(review_score >= 4 AS INTEGER) AS satisfied
  FROM timed),
split AS (
  SELECT *, CAST(row_number() OVER (ORDER BY order_purchase_timestamp, order_id, review_score)
               <= floor(0.8E0 * count(*) OVER ()) AS INTEGER) AS is_train
  FROM feat),
train AS (SELECT * FROM split WHERE is_train = 1),
test AS (SELECT * FROM split WHERE is_train = 0)"""


def with_ctes(*blocks: str, body: str) -> str:
    """``WITH <blocks> <body>`` with blocks joined by commas."""
    parts = [b.strip().rstrip(",") for b in blocks if b.strip()]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def on_master(body: str, *extra_ctes: str) -> str:
    """SQL over the fixture + master + feature CTEs plus optional extras."""
    return with_ctes(FIXTURE_CTES, MASTER_CTES, *extra_ctes, body=body)
