"""E-8: the order-level labelled frame, composed lazily.

``load_retention_frame`` = window the order spine → master join → churn label.
Filtering the spine before joining gives the same rows as the reference's
join-then-filter (the cutoff only reads order columns) with less join work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.operators.labels import add_churn_label, apply_observation_window
from lapsewise.operators.orders import MASTER_COLUMNS, attach_customers, attach_order_sides
from lapsewise.sources.driver import PAYMENT_ORDER, model_tables

#: Observation window of the registered queries, in months.
TEST_WINDOW_MONTHS = 6


def load_retention_frame(tables: dict[str, DataFrame], months: int = 6,
                         payment_order=("payment_sequential",),
                         review_tie: str = "review_id") -> DataFrame:
    """Window → customers → label on the narrow spine → per-order sides.

    Same rows and columns as window(join_tables) + add_churn_label: the label
    only reads the customer and order ids, so it is computed before the wide
    (review text) columns are attached and no wide row is shuffled twice.
    """
    spine = apply_observation_window(tables["orders"], months)
    narrow = add_churn_label(attach_customers(spine, tables["customers"]))
    wide = attach_order_sides(narrow, tables, payment_order, review_tie)
    return wide.select(*MASTER_COLUMNS, "orders_placed", "churned")


def driver_frame(spark: SparkSession, sf_dir: str, months: int = TEST_WINDOW_MONTHS) -> DataFrame:
    """The labelled order frame over the driver tables."""
    return load_retention_frame(model_tables(spark, sf_dir), months, payment_order=PAYMENT_ORDER)


def present(df: DataFrame) -> DataFrame:
    """Output hygiene for compared results: doubles rounded to 6 decimals,
    integral types widened to bigint, timestamps rendered as text."""
    cols = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if t in ("double", "float"):
            c = F.round(c.cast("double"), 6)
        elif t in ("integer", "short", "byte", "long"):
            c = c.cast("bigint")
        elif t in ("timestamp", "timestamp_ntz"):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)
