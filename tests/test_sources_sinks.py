"""CSV loader contracts (nine keys, typed timestamps, missing file) and sink round trips."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from lapsewise.sources.files import TABLE_FILES, load_raw_tables, source_summary
from lapsewise.sources.schemas import SCHEMAS
from lapsewise.sources.sinks import (
    read_feature_names,
    read_fold,
    write_feature_names,
    write_folds,
)


def _write_csvs(d):
    for key, fname in TABLE_FILES.items():
        cols = [f.name for f in SCHEMAS[key].fields]
        with open(os.path.join(d, fname), "w") as fh:
            fh.write(",".join(cols) + "\n")
            if key == "orders":
                fh.write('o1,c1,delivered,2018-01-02 10:00:00,,,2018-01-09 10:00:00,2018-01-10 00:00:00\n')
            if key == "order_reviews":
                fh.write('r1,o1,5,,"muito bom,\nchegou ""rapido""",2018-01-10 00:00:00,2018-01-11 00:00:00\n')


def test_nine_tables_typed_and_multiline(spark):
    d = tempfile.mkdtemp()
    _write_csvs(d)
    t = load_raw_tables(spark, d)
    assert set(t) == set(TABLE_FILES) and len(t) == 9
    o = t["orders"].first()
    assert dict(t["orders"].dtypes)["order_purchase_timestamp"] == "timestamp_ntz"
    assert o["order_purchase_timestamp"].hour == 10 and o["order_approved_at"] is None
    r = t["order_reviews"].first()
    assert r["review_comment_message"] == 'muito bom,\nchegou "rapido"'
    rows = {x["table"]: x["rows"] for x in source_summary(t).collect()}
    assert rows["orders"] == 1 and rows["sellers"] == 0


def test_columns_go_by_name_and_bad_values_are_loud(spark):
    d = tempfile.mkdtemp()
    _write_csvs(d)
    with open(os.path.join(d, TABLE_FILES["customers"]), "w") as fh:
        fh.write("customer_unique_id,note,customer_id,customer_zip_code_prefix,customer_city,customer_state\n"
                 "U1,x,C1,1,a,SP\n")
    r = load_raw_tables(spark, d)["customers"].first()
    assert (r["customer_id"], r["customer_unique_id"], r["note"]) == ("C1", "U1", "x")
    with open(os.path.join(d, TABLE_FILES["orders"]), "a") as fh:
        fh.write("o2,c2,delivered,2018-13-45,,,,\n")
    with pytest.raises(Exception, match="order_purchase_timestamp"):
        load_raw_tables(spark, d)["orders"].collect()
    with open(os.path.join(d, TABLE_FILES["payments"]), "w") as fh:
        fh.write("order_id\no1\n")
    with pytest.raises(ValueError, match="payment_value"):
        load_raw_tables(spark, d)


def test_importance_round_trip(spark):
    from lapsewise.sources.sinks import read_importance, write_table
    d = tempfile.mkdtemp() + "/importance"
    write_table(spark.createDataFrame([("b", 0.1, 2), ("a", 0.5, 1)],
                                      "feature string, mean_abs_shap double, rank int"), d)
    assert [r["feature"] for r in read_importance(spark, d).collect()] == ["a", "b"]


def test_missing_file_named(spark):
    d = tempfile.mkdtemp()
    _write_csvs(d)
    os.remove(os.path.join(d, TABLE_FILES["payments"]))
    with pytest.raises(FileNotFoundError, match="payments"):
        load_raw_tables(spark, d)


def test_fold_and_names_round_trip(spark):
    d = tempfile.mkdtemp()
    df = spark.range(20).select(F.col("id").alias("order_id"),
                                F.when(F.col("id") < 4, "test").otherwise("train").alias("fold"))
    write_folds(df, d + "/folds")
    assert read_fold(spark, d + "/folds", "test").count() == 4
    write_feature_names(spark, ["b", "a", "c"], d + "/names")
    assert read_feature_names(spark, d + "/names") == ["b", "a", "c"]
