"""Window and label contracts (reference tests on the loader, re-expressed)."""
import datetime as dt

from pyspark.sql import functions as F

from lapsewise.functions.exprs import months_before
from lapsewise.operators.labels import (
    add_churn_label,
    apply_observation_window,
    customer_churn_summary,
)


def test_window_keeps_rows_strictly_before_cutoff(spark):
    # 24 month starts from 2017-01-01: last 2018-12-01, cutoff 2018-06-01 excluded
    rows = [(dt.datetime(2017 + m // 12, m % 12 + 1, 1),) for m in range(24)]
    df = spark.createDataFrame(rows, "order_purchase_timestamp timestamp_ntz")
    out = apply_observation_window(df, months=6)
    assert out.count() == 17
    assert out.agg(F.max("order_purchase_timestamp")).first()[0] == dt.datetime(2018, 5, 1)


def test_null_timestamp_falls_out(spark):
    df = spark.createDataFrame([(dt.datetime(2018, 1, 1),), (None,), (dt.datetime(2019, 1, 1),)],
                               "order_purchase_timestamp timestamp_ntz")
    assert apply_observation_window(df, 6).count() == 1


def test_month_end_clamp_keeps_time_of_day(spark):
    df = spark.createDataFrame([(dt.datetime(2018, 8, 31, 13, 45, 7),)], "t timestamp_ntz")
    got = df.select(months_before("t", 6).alias("c")).first()["c"]
    assert got == dt.datetime(2018, 2, 28, 13, 45, 7)


def test_label_one_order_is_churned(spark):
    df = spark.createDataFrame([("cust_a", "o1"), ("cust_a", "o2"), ("cust_b", "o3")],
                               "customer_unique_id string, order_id string")
    out = {r["order_id"]: r for r in add_churn_label(df).collect()}
    assert out["o1"]["churned"] is False and out["o2"]["churned"] is False
    assert out["o3"]["churned"] is True
    assert out["o1"]["orders_placed"] == 2


def test_label_counts_distinct_orders_and_null_customer(spark):
    df = spark.createDataFrame([("a", "o1"), ("a", "o1"), (None, "o9")],
                               "customer_unique_id string, order_id string")
    out = add_churn_label(df).collect()
    a = [r for r in out if r["customer_unique_id"] == "a"]
    assert all(r["churned"] for r in a) and all(r["orders_placed"] == 1 for r in a)
    nul = [r for r in out if r["customer_unique_id"] is None][0]
    assert nul["churned"] is False and nul["orders_placed"] is None


def test_customer_level_rate(spark):
    df = spark.createDataFrame([("a", "o1"), ("a", "o2"), ("b", "o3"), ("c", "o4")],
                               "customer_unique_id string, order_id string")
    r = customer_churn_summary(add_churn_label(df)).first()
    assert (r["customers"], r["churned_customers"], r["retained_customers"]) == (3, 2, 1)
    assert abs(r["churn_rate"] - 2 / 3) < 1e-6


def test_driver_data_churn_rate_in_band(spark):
    from lapsewise.plans.queries import QUERIES
    r = QUERIES["churn_rate_customer"](spark, "/root/testdata/sf0.01").first()
    assert 0.95 <= r["churn_rate"] <= 0.99
