"""Orders stored by month, and the figures gathered by the pass that writes."""

import datetime as dt
import glob

from pyspark.sql import functions as F

from lapsewise.operators.labels import apply_observation_window
from lapsewise.sources import order_store as OS

SCHEMA = "order_id long, order_purchase_timestamp timestamp_ntz, note string"


def orders(spark, n=400):
    start = dt.datetime(2017, 1, 1)
    rows = [(i, None if i % 41 == 0 else start + dt.timedelta(days=2 * (i * 7 % n), hours=i % 24),
             None if i % 3 else "x") for i in range(n)]
    return spark.createDataFrame(rows + [rows[5]], SCHEMA).repartition(4)


def test_window_of_stored_orders_is_the_window(spark, tmp_path):
    df, path = orders(spark), str(tmp_path / "o")
    OS.write_orders_by_month(df, path)
    for months in (0, 1, 6, 40):
        want = sorted(map(str, apply_observation_window(df, months).collect()))
        assert sorted(map(str, OS.read_window(spark, path, months).select(*df.columns).collect())) == want


def test_later_months_are_not_opened(spark, tmp_path):
    df, path = orders(spark), str(tmp_path / "o")
    OS.write_orders_by_month(df, path)
    window = OS.read_window(spark, path, 6)
    cutoff = spark.range(1).select(OS.stored_cutoff(spark, path, 6).alias("c")).first()["c"]
    spoilt = 0
    for file in glob.glob(f"{path}/orders/*/*.parquet"):
        month = file.split(OS.MONTH + "=")[1].split("/")[0]
        if not month.startswith("m") or month > cutoff.strftime("m%Y-%m"):
            with open(file, "wb") as f:
                f.write(b"spoilt")
            spoilt += 1
    assert spoilt > 5
    assert window.count() == apply_observation_window(df, 6).count()


def test_figures_come_with_the_write(spark, tmp_path):
    df = orders(spark)
    got = OS.write_with_figures(df, str(tmp_path / "t"), last=F.max("order_purchase_timestamp"))
    want = df.agg(F.count("*"), F.count("note"), F.max("order_purchase_timestamp")).first()
    assert (got["rows"], got["rows"] - got["nulls"]["note"], got["last"]) == tuple(want)
    assert spark.read.parquet(str(tmp_path / "t")).count() == got["rows"]


def test_empty_table(spark, tmp_path):
    none, path = spark.createDataFrame([], SCHEMA), str(tmp_path / "o")
    got = OS.write_with_figures(none, str(tmp_path / "t"), last=F.max("order_purchase_timestamp"))
    assert got == {"rows": 0, "nulls": {c: 0 for c in none.columns}, "last": None}
    OS.write_orders_by_month(none, path)
    assert spark.read.parquet(f"{path}/figures").first()["rows"] == 0
    assert OS.read_window(spark, path).count() == 0
    table = OS.write_tables({"a": none, "b": orders(spark, 10)}, str(tmp_path / "all"))
    assert {(r["table"], r["column"]): (r["rows"], r["null_count"]) for r in table.collect()}[("b", "note")] == (11, 7)
