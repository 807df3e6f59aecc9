"""Orders written by month, and the figures that the writing pass gathers (S-11, A-18, P-2, A-7).

``write_with_figures`` attaches an ``Observation`` to the write, so row counts,
nulls and the last time cost no job of their own. ``write_orders_by_month``
keeps the figures and the schema beside the data; the cutoff then needs no scan of the orders,
and the windowed read opens only the months before it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lapsewise.functions.exprs import months_before

TS, MONTH = "order_purchase_timestamp", "purchase_month"
#: The letter keeps the folder's name a text when partition types are inferred.
MONTH_FORMAT = "'m'yyyy-MM"


def write_with_figures(df: DataFrame, path: str, by: str | None = None, **figures) -> dict:
    """Write ``df`` as Parquet and return its figures, gathered in the same pass.

    rows, and nulls: a count for each column; more as named aggregates. An
    empty table has 0 rows, 0 nulls and null for a maximum.
    """
    seen = Observation()
    nulls = {f"__null_{i}": F.count(F.when(F.col(f"`{c}`").isNull(), 1)) for i, c in enumerate(df.columns)}
    every = {"rows": F.count(F.lit(1)), **nulls, **figures}
    observed = df.observe(seen, *[c.alias(n) for n, c in every.items()])
    writer = observed.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    got = seen.get
    return {"rows": got["rows"], "nulls": {c: got[f"__null_{i}"] for i, c in enumerate(df.columns)},
            **{n: got[n] for n in figures}}


def write_tables(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """S-11 and A-18 of all tables, each written once: table, column, rows, cols, null_count (a row a column)."""
    spark = next(iter(tables.values())).sparkSession
    out = []
    for name, df in tables.items():
        got = write_with_figures(df, f"{path}/{name}")
        out += [(name, c, got["rows"], len(df.columns), got["nulls"][c]) for c in df.columns]
    return spark.createDataFrame(out, "table string, column string, rows long, cols long, null_count long")


def write_orders_by_month(orders: DataFrame, path: str, ts: str = TS) -> None:
    """Orders in one folder a month, and the last time beside them.

    Every task writes its rows where they are, without an exchange, so a month
    with a third of all rows is no single task's; orders without a time go to
    the null month, which no window reads.
    """
    dated = orders.withColumn(MONTH, F.date_format(ts, MONTH_FORMAT))
    got = write_with_figures(dated, f"{path}/orders", by=MONTH, last=F.max(ts))
    kind = orders.schema[ts].dataType.simpleString()
    (orders.sparkSession.createDataFrame([(got["rows"], got["last"], dated.schema.json())],
                                        f"rows long, last {kind}, fields string")
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/figures"))


def stored_cutoff(spark: SparkSession, path: str, months: int = 6):
    """A-7: the window's end from the stored figures, as a scalar subquery; null for an empty table."""
    return months_before(spark.read.parquet(f"{path}/figures").agg(F.max("last")).scalar(), months)


def read_window(spark: SparkSession, path: str, months: int = 6, ts: str = TS) -> DataFrame:
    """P-2 over ``write_orders_by_month``: rows before the cutoff; later months' files are not opened."""
    cutoff = stored_cutoff(spark, path, months)
    fields = spark.read.parquet(f"{path}/figures").first()["fields"]
    orders = spark.read.schema(StructType.fromJson(json.loads(fields))).parquet(f"{path}/orders")
    return orders.where((F.col(MONTH) <= F.date_format(cutoff, MONTH_FORMAT)) & (F.col(ts) < cutoff)).drop(MONTH)
