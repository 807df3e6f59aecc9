"""Behavioural features, imputation, feature selection (E-1 … E-3, P-9 … P-17, A-18, A-21).

Scale notes: the behavioural columns are one projection (whole-stage
codegen, no shuffle). Imputation needs global medians: they come from the
bounded two-pass exact quantile (``operators.stats``) as one row, attached
with a broadcast of that single row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.functions.exprs import days_between, is_true, r6, safe_div
from lapsewise.operators.joins import with_scalars
from lapsewise.operators.stats import exact_quantiles, exact_quantiles_long

BEHAVIORAL_COLUMNS = ("delivery_delay_days", "is_late_delivery", "days_to_delivery",
                      "freight_ratio", "is_single_item")

# Imputation strategy per column ("median" or a constant fill).
IMPUTE_SPEC = {
    "delivery_delay_days": "median",
    "days_to_delivery": "median",
    "review_score": "median",
    "freight_ratio": 0.0,
    "total_freight": "median",
    "payment_value": "median",
    "payment_installments": "median",
}

# Columns never used as model input (identifiers, raw times,
# free text, leaky counts, source categoricals, a redundant amount).
EXCLUDED_COLUMNS = frozenset({
    "churned", "customer_unique_id", "order_id", "order_purchase_timestamp",
    "order_delivered_customer_date", "order_estimated_delivery_date",
    "order_delivered_carrier_date", "order_approved_at", "review_comment_message",
    "order_status", "customer_id", "customer_city", "product_category_english",
    "orders_placed", "orders_placed_filtered", "customer_state", "payment_type",
    "total_item_price",
})

SUMMARY_FEATURES = ("delivery_delay_days", "is_late_delivery", "days_to_delivery",
                    "freight_ratio", "is_single_item", "payment_installments", "review_score")


def add_behavioral_features(df: DataFrame) -> DataFrame:
    """E-1: delivery delay/duration in fractional days, late flag, freight share, single item."""
    delay = days_between("order_delivered_customer_date", "order_estimated_delivery_date")
    return (df.withColumn("delivery_delay_days", delay)
            .withColumn("is_late_delivery", is_true(F.col("delivery_delay_days") > 0))
            .withColumn("days_to_delivery",
                        days_between("order_delivered_customer_date", "order_purchase_timestamp"))
            .withColumn("freight_ratio", safe_div("total_freight", "payment_value"))
            .withColumn("is_single_item", is_true(F.col("item_count") == 1)))


def fill_values(fit: DataFrame, spec: dict = IMPUTE_SPEC) -> DataFrame:
    """One row: the fill value of every column of ``spec`` present in ``fit``."""
    med = [c for c, s in spec.items() if s == "median" and c in fit.columns]
    fixed = {c: s for c, s in spec.items() if s != "median" and c in fit.columns}
    row = exact_quantiles(fit, med, 0.5) if med else fit.sparkSession.range(1).drop("id")
    return row.select(*[F.col(c) for c in med],
                      *[F.lit(float(v)).alias(c) for c, v in fixed.items()])


def impute_missing_values(df: DataFrame, fit: DataFrame | None = None,
                          spec: dict = IMPUTE_SPEC, fill_item_count: float | None = None) -> DataFrame:
    """E-2 / E-3: fill NULLs by median (of ``fit``, default ``df``) or constant.

    Columns absent from ``df`` are skipped. Flags are re-derived from the
    filled bases afterwards. ``fill_item_count=1`` reproduces the modelling
    variant that treats orders without items as single-item orders.
    """
    fit = df if fit is None else fit
    present = [c for c in spec if c in df.columns]
    out = df
    if present:
        fills = fill_values(fit, {c: spec[c] for c in present})
        names = {c: f"__fill_{c}" for c in present}
        fills = fills.select(*[F.col(c).alias(n) for c, n in names.items()])
        # one row of fill values, attached as scalar subqueries
        out = with_scalars(df, fills)
        out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(n))
                               for c, n in names.items()}).drop(*names.values())
    return _flags_again(out, fill_item_count)


def impute_by_values(df: DataFrame, fills: dict[str, float], fill_item_count: float | None = None) -> DataFrame:
    """E-3 with fill values at hand (column -> value); columns that ``df`` lacks are skipped."""
    out = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v).cast("double"))
                          for c, v in fills.items() if c in df.columns})
    return _flags_again(out, fill_item_count)


def _flags_again(out: DataFrame, fill_item_count: float | None) -> DataFrame:
    """The flags, from the filled columns that they stand for."""
    if fill_item_count is not None and "item_count" in out.columns:
        out = out.withColumn("item_count", F.coalesce(F.col("item_count"),
                                                      F.lit(fill_item_count).cast("bigint")))
    if "delivery_delay_days" in out.columns:
        out = out.withColumn("is_late_delivery", is_true(F.col("delivery_delay_days") > 0))
    if "item_count" in out.columns:
        out = out.withColumn("is_single_item", is_true(F.col("item_count") == 1))
    return out


def null_audit(df: DataFrame, cols: Sequence[str] | None = None,
               only_positive: bool = False) -> DataFrame:
    """A-18: ``(column_name, null_count, null_share)`` in one aggregation pass."""
    cols = list(cols or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in cols])
    long = wide.select("__n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("null_count"))
        for c in cols])).alias("p")).select("__n", "p.*")
    out = long.select("column_name", "null_count",
                      r6(F.col("null_count") / F.greatest(F.col("__n"), F.lit(1))).alias("null_share"))
    return out.where(F.col("null_count") > 0) if only_positive else out


def feature_columns(df: DataFrame, excluded=EXCLUDED_COLUMNS) -> list[str]:
    """P-15: model inputs = every column not excluded, in frame order (schema only)."""
    return [c for c in df.columns if c not in excluded]


def booleans_to_int(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P-13: cast boolean columns to int (0/1)."""
    cols = set(cols or df.columns)
    return df.select(*[F.col(f"`{f.name}`").cast("int").alias(f.name)
                       if f.name in cols and f.dataType.typeName() == "boolean"
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def feature_summary(df: DataFrame, cols: Sequence[str] = SUMMARY_FEATURES) -> DataFrame:
    """A-21: per feature mean, exact median, null count and null share."""
    cols = [c for c in cols if c in df.columns]
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols]
    long = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    agg = long.groupBy("feature").agg(F.avg("x").alias("mean"),
                                      F.count(F.when(F.col("x").isNull(), 1)).alias("null_count"))
    med = exact_quantiles_long(df, cols, 0.5).withColumnRenamed("name", "feature") \
        .withColumnRenamed("value", "median")
    return (with_scalars(agg.join(med, "feature", "left"), n)
            .select("feature", r6("mean").alias("mean"), r6("median").alias("median"),
                    "null_count",
                    r6(F.col("null_count") / F.greatest(F.col("__n"), F.lit(1))).alias("null_share")))
