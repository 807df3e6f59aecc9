"""J-4 … J-6 / J-13 over co-bucketed sides: written once by ``order_id``, joined again and again without an exchange.

Each side is brought to one row an order before it is written (the aggregates
combine map-side), so an order with a third of all lines fills no bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.operators.joins import left_attach
from lapsewise.operators.orders import (MASTER_COLUMNS, REVIEW_COLUMNS, attach_customers, items_per_order,
                                        latest_review, payments_per_order)

KEY = "order_id"
SIDES = ("reviews", "items", "payments")


def write_sides(tables: dict[str, DataFrame], name: str, path: str, buckets: int,
                payment_order: Sequence[str] = ("payment_sequential",), review_tie: str = "review_id") -> None:
    """Tables ``<name>_spine`` (orders with their customers) and one a side, bucketed and sorted by ``order_id``.

    ``path``: a shared folder for their files. One file a bucket and table;
    choose ``buckets`` so that one of the widest (reviews) fits in a task. The files
    are packed with zstd: they are mostly texts.
    """
    frames = {"spine": attach_customers(tables["orders"], tables["customers"]),
              "reviews": latest_review(tables["order_reviews"], review_tie).select(KEY, *REVIEW_COLUMNS),
              "items": items_per_order(tables["order_items"], tables.get("products"),
                                       tables.get("category_translation")),
              "payments": payments_per_order(tables["payments"], payment_order)}
    for side, df in frames.items():
        (df.repartition(buckets, KEY).write.bucketBy(buckets, KEY).sortBy(KEY)
         .option("compression", "zstd").option("path", f"{path}/{side}").saveAsTable(f"{name}_{side}"))


def stored_master(spark: SparkSession, name: str) -> DataFrame:
    """J-13 from ``write_sides``: the rows and columns of ``join_tables``, without an exchange by ``order_id``."""
    out = spark.table(f"{name}_spine")
    for side in SIDES:
        out = left_attach(out, spark.table(f"{name}_{side}"), KEY)
    return out.select(*[F.col(c) for c in MASTER_COLUMNS])


def forget_sides(spark: SparkSession, name: str) -> None:
    """Drop the tables' names; the files stay in their folder."""
    for side in ("spine", *SIDES):
        spark.sql(f"DROP TABLE IF EXISTS `{name}_{side}`")
