"""Null, tie and grain rules of the order-level aggregates (fixtures FIXTURES §D)."""
import datetime as dt

from lapsewise.operators.orders import (
    items_per_order,
    latest_review,
    payments_per_order,
)


def test_latest_review_undated_wins_then_latest_then_tiebreak(spark):
    t = dt.datetime
    rows = [("r1", "o1", 1, "a", t(2018, 1, 1)), ("r2", "o1", 2, "b", t(2018, 3, 1)),
            ("r3", "o1", 3, "c", None),
            ("r4", "o2", 4, "d", t(2018, 1, 1)), ("r5", "o2", 5, "e", t(2018, 1, 1)),
            ("r6", "o3", 1, "f", t(2018, 1, 1)), ("r7", "o3", 2, "g", t(2018, 2, 1))]
    df = spark.createDataFrame(rows, "review_id string, order_id string, review_score int, "
                                     "review_comment_message string, review_answer_timestamp timestamp_ntz")
    got = {r["order_id"]: r["review_id"] for r in latest_review(df).collect()}
    assert got == {"o1": "r3", "o2": "r5", "o3": "r7"}


def test_modal_category_tie_null_and_missing_lookup(spark):
    items = spark.createDataFrame(
        [("o1", 1, "p_a", 1.0, 0.1), ("o1", 2, "p_b", 1.0, 0.1),  # tie a/b → smallest
         ("o2", 1, "p_null", 2.0, None),                          # null category only
         ("o3", 1, "p_missing", None, None)],                     # not in lookup
        "order_id string, order_item_id int, product_id string, price double, freight_value double")
    products = spark.createDataFrame([("p_a", "x"), ("p_b", "y"), ("p_null", None),
                                      ("p_missing", "zz")],
                                     "product_id string, product_category_name string")
    lookup = spark.createDataFrame([("x", "alpha"), ("y", "beta")],
                                   "product_category_name string, product_category_name_english string")
    got = {r["order_id"]: r for r in items_per_order(items, products, lookup).collect()}
    assert got["o1"]["product_category_english"] == "alpha"
    assert got["o1"]["item_count"] == 2 and abs(got["o1"]["total_freight"] - 0.2) < 1e-12
    assert got["o2"]["product_category_english"] is None
    assert got["o3"]["product_category_english"] is None
    assert got["o3"]["total_item_price"] == 0.0 and got["o3"]["total_freight"] == 0.0


def test_payments_all_null_and_first_type(spark):
    df = spark.createDataFrame(
        [("o1", 2, "voucher", 3, 10.0), ("o1", 1, None, 1, 5.0),
         ("o2", 1, "card", None, None), ("o2", 2, "card", None, None),
         ("o3", 1, "boleto", 2, 0.0)],
        "order_id string, payment_sequential int, payment_type string, "
        "payment_installments int, payment_value double")
    got = {r["order_id"]: r for r in payments_per_order(df).collect()}
    assert got["o1"]["payment_type"] is None          # first row's null type is kept
    assert got["o1"]["payment_value"] == 15.0 and got["o1"]["payment_installments"] == 3
    assert got["o2"]["payment_value"] == 0.0 and got["o2"]["payment_installments"] is None
    assert got["o3"]["payment_value"] == 0.0


def test_master_join_one_row_per_order(spark):
    from lapsewise.operators.orders import join_tables
    from lapsewise.sources.driver import PAYMENT_ORDER, model_tables
    t = model_tables(spark, "/root/testdata/sf0.001")
    m = join_tables(t, payment_order=PAYMENT_ORDER)
    assert m.count() == t["orders"].count() == m.select("order_id").distinct().count()


def test_null_safe_lookup_matches_null_keys(spark):
    items = spark.createDataFrame([("o1", 1, "p1", 1.0, 0.1)],
                                  "order_id string, order_item_id int, product_id string, "
                                  "price double, freight_value double")
    products = spark.createDataFrame([("p1", None)], "product_id string, product_category_name string")
    lookup = spark.createDataFrame([(None, "unnamed")],
                                   "product_category_name string, product_category_name_english string")
    plain = items_per_order(items, products, lookup).first()["product_category_english"]
    pandas_like = items_per_order(items, products, lookup, null_safe_lookup=True) \
        .first()["product_category_english"]
    assert plain is None and pandas_like == "unnamed"
