"""Censoring window and churn label (P-2, A-4 … A-12, J-7, J-11).

Scale notes
-----------
* The cutoff is a scalar subquery (one ``max``), evaluated once and inlined
  into the filter: no join with a growing table.
* ``count(DISTINCT order_id)`` per customer is planned by Spark as a
  two-level aggregation, first on (customer, order) and then on customer, so
  a customer holding a third of all orders is pre-aggregated in many tasks.
  The count table is attached back with a shuffle join on the customer key;
  AQE's skew-join splitting handles a hot customer on the order side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.functions.exprs import is_true, months_before, r6
from lapsewise.operators.joins import left_attach

TS = "order_purchase_timestamp"
CUSTOMER = "customer_unique_id"


def observation_cutoff(df: DataFrame, months: int = 6, ts: str = TS, days: int = 0):
    """A-7 / F-2: ``max(ts)`` less the months and days, as a scalar-subquery Column."""
    cutoff = months_before(df.agg(F.max(ts)).scalar(), months)
    return cutoff - F.make_dt_interval(F.lit(days)) if days else cutoff


def apply_observation_window(df: DataFrame, months: int = 6, ts: str = TS, days: int = 0) -> DataFrame:
    """P-2: keep rows strictly before ``max(ts)`` less the months and days; NULL times drop out."""
    return df.where(F.col(ts) < observation_cutoff(df, months, ts, days))


def window_bounds(df: DataFrame, months: int = 6, ts: str = TS) -> DataFrame:
    """A-7 / F-3: one row ``(last_order, cutoff, last_order_date, cutoff_date)`` describing the window."""
    return (df.agg(F.max(ts).alias("last_order"))
            .select("last_order", months_before("last_order", months).alias("cutoff"))
            .withColumns({"last_order_date": F.to_date("last_order"), "cutoff_date": F.to_date("cutoff")}))


def orders_per_customer(df: DataFrame, customer: str = CUSTOMER,
                        order: str = "order_id") -> DataFrame:
    """A-4: distinct orders per customer; NULL customers are not a group."""
    return (df.where(F.col(customer).isNotNull())
            .groupBy(customer).agg(F.countDistinct(order).alias("orders_placed")))


def order_rows_per_customer(df: DataFrame, customer: str = CUSTOMER,
                            order: str = "order_id") -> DataFrame:
    """A-5: the row-count variant (``count(order_id)``, duplicates counted)."""
    return (df.where(F.col(customer).isNotNull())
            .groupBy(customer).agg(F.count(order).alias("orders_placed")))


def add_churn_label(df: DataFrame, customer: str = CUSTOMER, order: str = "order_id",
                    distinct: bool = True) -> DataFrame:
    """A-6 + J-7: ``orders_placed`` and ``churned = orders_placed == 1``.

    A customer with a NULL id gets NULL ``orders_placed`` and churned False.
    """
    counts = (orders_per_customer if distinct else order_rows_per_customer)(df, customer, order)
    return (left_attach(df, counts, customer)
            .withColumn("churned", is_true(F.col("orders_placed") == 1)))


def customer_churn_summary(labelled: DataFrame, customer: str = CUSTOMER) -> DataFrame:
    """A-8 / A-9: customer-level churn.

    One row per ``customer`` (a NULL id counts as one customer, as with
    ``drop_duplicates``); the label is constant per customer.
    """
    per_customer = labelled.groupBy(customer).agg(F.max(F.col("churned").cast("int")).alias("c"))
    return per_customer.agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("c").cast("bigint").alias("churned_customers"),
        F.sum(1 - F.col("c")).cast("bigint").alias("retained_customers"),
        r6(F.avg("c")).alias("churn_rate"))


def row_churn_rate(labelled: DataFrame, by: str | None = None) -> DataFrame:
    """A-10: row-level churn rate, optionally per ``by`` (e.g. fold)."""
    g = labelled.groupBy(by) if by else labelled.groupBy()
    return g.agg(F.count(F.lit(1)).alias("rows"),
                 r6(F.avg(F.col("churned").cast("double"))).alias("churn_rate"))


def censoring_report(spine: DataFrame, months: int = 6, ts: str = TS,
                     customer: str = CUSTOMER) -> DataFrame:
    """A-12: orders and distinct customers before/after the window, customers removed."""
    cutoff = observation_cutoff(spine, months, ts)
    inside = is_true(F.col(ts) < cutoff)
    return (spine.agg(
        F.count(F.lit(1)).alias("orders_before"),
        F.countDistinct(customer).alias("customers_before"),
        F.count(F.when(inside, 1)).alias("orders_after"),
        F.countDistinct(F.when(inside, F.col(customer))).alias("customers_after"))
        .withColumn("customers_removed", F.col("customers_before") - F.col("customers_after"))
        .withColumn("removed_share",
                    r6(F.col("customers_removed") / F.greatest(F.col("customers_before"),
                                                               F.lit(1)))))
