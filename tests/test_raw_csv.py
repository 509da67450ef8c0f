"""The raw nine-CSV path with string ids, extra columns and quoted
multi-line text, hand-checked end to end."""

import math

from pyspark.sql import functions as F

from routewise.plans import corridors
from routewise.plans.prepare import build_master, engineer_features
from routewise.schemas import RAW_FILES
from routewise.sources import load_raw_tables

CSV = {
    "orders": """order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date
o1,c1,delivered,2017-10-02 10:56:33,2017-10-02 11:07:15,2017-10-04 19:55:00,2017-10-10 21:25:13,2017-10-18 00:00:00
o2,c2,delivered,2018-07-24 20:41:37,2018-07-26 03:24:27,2018-07-26 14:31:00,2018-08-07 15:27:45,2018-08-01 00:00:00
o3,c1,shipped,2018-08-08 08:38:49,2018-08-08 08:55:23,2018-08-08 13:50:00,,2018-09-04 00:00:00
o4,c3,delivered,2018-08-10 12:00:00,,,,2018-08-20 00:00:00
""",
    "reviews": """review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp
r1,o1,4,,"great
product, arrived early",2017-10-11 00:00:00,2017-10-12 03:43:48
r2,o2,1,"late","it was late",2018-08-08 00:00:00,2018-08-08 18:37:50
r3,o2,2,,,2018-08-09 00:00:00,2018-08-10 00:00:00
""",
    "items": """order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value
o1,1,p1,s1,2017-10-06 11:07:15,29.99,8.72
o1,2,p2,s2,2017-10-06 11:07:15,10.00,1.28
o2,1,p2,s2,2018-07-30 03:24:27,118.70,22.76
""",
    "payments": """order_id,payment_sequential,payment_type,payment_installments,payment_value
o1,1,credit_card,1,18.12
o1,2,voucher,1,2.00
o1,3,voucher,1,18.59
o2,1,boleto,1,141.46
""",
    "products": """product_id,product_category_name,product_name_lenght,product_weight_g
p1,utilidades_domesticas,40,500
p2,,44,
""",
    "categories": """product_category_name,product_category_name_english
utilidades_domesticas,housewares
""",
    "customers": """customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state
c1,u1,3149,sao paulo,SP
c2,u2,47813,barreiras,BA
""",
    "sellers": """seller_id,seller_zip_code_prefix,seller_city,seller_state
s1,3149,sao paulo,SP
s2,13023,campinas,SP
""",
    "geolocation": """geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state
3149,-23.57,-46.65,sao paulo,SP
3149,-23.59,-46.63,sao paulo,SP
47813,-12.15,-44.99,barreiras,BA
13023,-22.89,-47.06,campinas,SP
""",
}


def _write(tmp_path):
    for table, text in CSV.items():
        (tmp_path / RAW_FILES[table]).write_text(text)
    return str(tmp_path)


def test_raw_csv_master_by_hand(spark, tmp_path):
    t = load_raw_tables(spark, _write(tmp_path))
    m = engineer_features(build_master(t), None)
    rows = {(r.order_id, r.review_score): r for r in m.collect()}
    # o3 is not delivered and o4 has no delivery date; o2 has two reviews
    assert set(rows) == {("o1", 4), ("o2", 1), ("o2", 2)}
    o1 = rows[("o1", 4)]
    assert o1.seller_id == "s1" and o1.num_items == 2
    assert math.isclose(o1.total_order_value, 29.99 + 8.72 + 10.00 + 1.28)
    assert o1.primary_payment_type == "voucher" and o1.payment_installments == 1
    assert o1.product_category_name_english == "housewares" and o1.product_weight_g == 500.0
    assert o1.corridor == "SP -> SP" and o1.same_state == 1
    assert math.isclose(o1.cust_lat, -23.58) and o1.distance_km == 0.0 and o1.distance_band is None
    assert o1.cat_housewares == 1 and o1.satisfied == 1 and o1.is_late == 0
    o2 = rows[("o2", 1)]
    assert o2.same_state == 0 and o2.corridor == "SP -> BA" and o2.is_late == 1
    assert o2.product_category_name_english is None and o2.product_weight_g is None
    assert o2.distance_km > 1000 and o2.distance_band == ">1000km"
    # delivered 2018-08-07 15:27:45 vs estimated 2018-08-01 00:00:00
    assert math.isclose(o2.delivery_delay_days, 6 + (15 * 3600 + 27 * 60 + 45) / 86400.0)
    corr = {r.corridor: r for r in corridors.corridor_stats(m, min_orders=1).collect()}
    assert corr["SP -> BA"].n == 2 and corr["SP -> BA"].sat_rate == 0.0


def test_raw_csv_multiline_review_kept(spark, tmp_path):
    t = load_raw_tables(spark, _write(tmp_path))
    assert t.reviews.count() == 3
    assert t.reviews.filter(F.col("order_id") == "o1").first().review_score == 4
