"""Behavioural features, imputation and selection (reference feature tests)."""
import datetime as dt

from lapsewise.operators.features import (
    BEHAVIORAL_COLUMNS,
    add_behavioral_features,
    feature_columns,
    impute_missing_values,
    null_audit,
)

BASE = dt.datetime(2022, 6, 1)
SCHEMA = ("order_purchase_timestamp timestamp_ntz, order_estimated_delivery_date timestamp_ntz, "
          "order_delivered_customer_date timestamp_ntz, payment_value double, "
          "total_freight double, item_count int")


def one_order(spark, delivered_offset_days, payment=100.0, items=1):
    row = (BASE, BASE + dt.timedelta(days=10), BASE + dt.timedelta(days=10 + delivered_offset_days),
           payment, 10.0, items)
    return spark.createDataFrame([row], SCHEMA)


def test_five_columns(spark):
    out = add_behavioral_features(one_order(spark, 0))
    assert set(BEHAVIORAL_COLUMNS) <= set(out.columns)


def test_late_delivery(spark):
    r = add_behavioral_features(one_order(spark, 5)).first()
    assert r["delivery_delay_days"] > 0 and r["is_late_delivery"] is True
    assert r["days_to_delivery"] == 15.0 and r["freight_ratio"] == 0.1 and r["is_single_item"]


def test_early_delivery(spark):
    r = add_behavioral_features(one_order(spark, -3)).first()
    assert r["delivery_delay_days"] == -3.0 and r["is_late_delivery"] is False


def test_fractional_days_and_guarded_ratio(spark):
    df = spark.createDataFrame([(BASE, BASE, BASE + dt.timedelta(hours=36), 0.0, 5.0, None)], SCHEMA)
    r = add_behavioral_features(df).first()
    assert r["delivery_delay_days"] == 1.5
    assert r["freight_ratio"] is None and r["is_single_item"] is False


def test_imputation_fills_and_tolerates_absent_columns(spark):
    df = spark.createDataFrame([(1.0, 5, None, 1), (None, None, 50.0, 1), (3.0, 4, 100.0, 2)],
                               "delivery_delay_days double, review_score int, "
                               "payment_value double, item_count int")
    out = impute_missing_values(df).collect()
    assert [r["delivery_delay_days"] for r in out] == [1.0, 2.0, 3.0]
    assert [r["review_score"] for r in out] == [5.0, 4.5, 4.0]
    assert [r["payment_value"] for r in out] == [75.0, 50.0, 100.0]
    assert all(v is not None for r in out for v in r)
    assert [r["is_single_item"] for r in out] == [True, True, False]


def test_train_fitted_imputation(spark):
    df = spark.createDataFrame([(None, "test"), (1.0, "train"), (3.0, "train"), (100.0, "test")],
                               "payment_value double, fold string")
    out = impute_missing_values(df, fit=df.where("fold = 'train'")).collect()
    assert out[0]["payment_value"] == 2.0


def test_leaky_columns_not_selected(spark):
    df = spark.createDataFrame([(4.0, 100.0, 3, True)],
                               "review_score double, payment_value double, orders_placed int, churned boolean")
    cols = feature_columns(df)
    assert "orders_placed" not in cols and "churned" not in cols
    assert cols == ["review_score", "payment_value"]


def test_null_audit(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    got = {r["column_name"]: r["null_count"] for r in null_audit(df).collect()}
    assert got == {"a": 1, "b": 2}
    assert [r["column_name"] for r in null_audit(df.select("a"), only_positive=True).collect()] == ["a"]
