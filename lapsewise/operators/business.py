"""Business roll-ups (B-2 … B-4).

Grouped roll-ups over the scored rows: without keys they give the
reference's single totals, with keys (state, category, …) the same figures
per segment, still one aggregation pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.functions.exprs import fmt_pct
from lapsewise.operators.joins import with_scalars

# Campaign assumptions.
AVG_ORDER_VALUE = 160.0
ORDERS_PER_YEAR = 3.5
ANNUAL_REVENUE_PER_CUSTOMER = AVG_ORDER_VALUE * ORDERS_PER_YEAR
CAMPAIGN_COST_PER_CUSTOMER = 25.0
CONVERSION_RATE = 0.15


def _pred(prob: str, threshold_col: str):
    return (F.col(prob) >= F.col(threshold_col)).cast("int")


def revenue_opportunity(scored: DataFrame, threshold: DataFrame, keys: Sequence[str] = (),
                        label: str = "label", prob: str = "p_churn",
                        value: float = ANNUAL_REVENUE_PER_CUSTOMER) -> DataFrame:
    """B-2: retained rows found (TP on the retained class) and missed (FN), × annual value.

    ``threshold`` is a one-row DataFrame with a ``threshold`` column.
    """
    s = with_scalars(scored, threshold, ["threshold"])
    pred = _pred(prob, "threshold")
    out = s.groupBy(*keys).agg(
        F.count(F.when(F.col(label) == 0, 1)).alias("actual_retained"),
        F.count(F.when((F.col(label) == 0) & (pred == 0), 1)).alias("retained_tp"),
        F.count(F.when((F.col(label) == 0) & (pred == 1), 1)).alias("retained_fn"))
    return (out.withColumn("potential_revenue", F.col("retained_tp") * F.lit(value))
            .withColumn("revenue_at_risk", F.col("retained_fn") * F.lit(value)))


def campaign_roi(scored: DataFrame, threshold: DataFrame, total_customers: DataFrame,
                 keys: Sequence[str] = (), prob: str = "p_churn",
                 cost: float = CAMPAIGN_COST_PER_CUSTOMER, conversion: float = CONVERSION_RATE,
                 value: float = ANNUAL_REVENUE_PER_CUSTOMER) -> DataFrame:
    """B-3: share flagged as retained × customers → cost, conversions, revenue, net ROI %.

    Units as in the reference: the flagged share is over scored *orders*, scaled
    by the number of *customers* (``total_customers``: one row, column
    ``customers``). Net ROI % is (conversion·value − cost)/cost whatever the
    model flags; NULL when nothing is flagged.
    """
    s = with_scalars(scored, threshold, ["threshold"])
    pred = _pred(prob, "threshold")
    out = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("scored_rows"),
                               F.count(F.when(pred == 0, 1)).alias("flagged_retained"))
    out = with_scalars(out, total_customers, ["customers"])
    full = F.floor(F.col("flagged_retained") / F.col("scored_rows") * F.col("customers"))
    return (out.withColumn("flagged_full", full.cast("bigint"))
            .withColumn("campaign_cost", F.col("flagged_full") * F.lit(cost))
            .withColumn("expected_conversions", F.col("flagged_full") * F.lit(conversion))
            .withColumn("expected_revenue", F.col("expected_conversions") * F.lit(value))
            .withColumn("net_roi_pct", F.try_divide(F.col("expected_revenue") - F.col("campaign_cost"),
                                                    F.col("campaign_cost")) * F.lit(100.0)))


def opportunity_by_grain(scored: DataFrame, threshold: DataFrame, grains: dict[str, str],
                         label: str = "label", prob: str = "p_churn", customer: str = "customer_unique_id",
                         cost: float = CAMPAIGN_COST_PER_CUSTOMER, conversion: float = CONVERSION_RATE,
                         value: float = ANNUAL_REVENUE_PER_CUSTOMER) -> DataFrame:
    """B-2 and B-3 over all rows and for every level of the columns ``grains`` (grain name -> column).

    One scan and one aggregate (grouping sets). (grain, level) name a row; the
    grain 'all' has a null level, like a grain's rows without a level. customers
    are those of the row's scored orders; the share flagged is scaled to them.
    """
    names = list(grains)
    cols = [f"__g{i}" for i in range(len(names))]
    s = with_scalars(scored, threshold, ["threshold"]).withColumns(
        {c: F.col(grains[g]).cast("string") for c, g in zip(cols, names, strict=True)})
    kept, flagged = F.col(label) == 0, _pred(prob, "threshold") == 0
    out = s.groupingSets([[], *[[c] for c in cols]], *cols).agg(
        F.grouping_id().alias("__id"),
        F.count(F.when(kept, 1)).alias("actual_retained"),
        F.count(F.when(kept & flagged, 1)).alias("retained_tp"),
        F.count(F.when(kept & ~flagged, 1)).alias("retained_fn"),
        F.count(F.lit(1)).alias("scored_rows"), F.count(F.when(flagged, 1)).alias("flagged_retained"),
        F.count_distinct(customer).alias("customers"))
    full = (1 << len(cols)) - 1                 # a bit is 0 where its column is grouped by
    grain, level = F.lit("all"), F.lit(None).cast("string")
    for i, (c, g) in enumerate(zip(cols, names, strict=True)):
        own = F.col("__id") == full - (1 << (len(cols) - 1 - i))
        grain, level = F.when(own, F.lit(g)).otherwise(grain), F.when(own, F.col(c)).otherwise(level)
    sent = F.floor(F.col("flagged_retained") / F.col("scored_rows") * F.col("customers")).cast("bigint")
    return (out.where("scored_rows > 0")
            .withColumns({"grain": grain, "level": level, "flagged_full": sent})
            .withColumn("potential_revenue", F.col("retained_tp") * F.lit(value))
            .withColumn("revenue_at_risk", F.col("retained_fn") * F.lit(value))
            .withColumn("campaign_cost", F.col("flagged_full") * F.lit(cost))
            .withColumn("expected_revenue", F.col("flagged_full") * F.lit(conversion) * F.lit(value))
            .withColumn("net_roi_pct", F.try_divide(F.col("expected_revenue") - F.col("campaign_cost"),
                                                    F.col("campaign_cost")) * F.lit(100.0))
            .drop("__id", *cols))


#: What an encoded category name starts with, once underscores are spaces.
CATEGORY_PREFIX = "product category grouped "


def driver_name(feature):
    """F-10: a feature's name with spaces, without the prefix of encoded categories."""
    return F.replace(F.replace(feature, F.lit("_"), F.lit(" ")), F.lit(CATEGORY_PREFIX), F.lit(""))


def findings_record(churn: DataFrame, metrics: DataFrame, roi: DataFrame,
                    drivers: DataFrame | None = None, top_k: int = 5) -> DataFrame:
    """B-4: one row of numeric findings plus the ranked drivers as ``Rank n: name``.

    ``drivers`` has ``(feature, rank)``; at most ``top_k`` of them are listed.
    """
    rec = churn.select("customers", "churned_customers", "retained_customers", "churn_rate")
    rec = with_scalars(rec, metrics, ["roc_auc", "f1", "f1_churned", "threshold"])
    rec = with_scalars(rec, roi, ["flagged_full", "campaign_cost", "expected_revenue",
                                  "net_roi_pct"])
    rec = rec.withColumn("churn_rate_text", fmt_pct("churn_rate"))
    if drivers is not None:
        top = (drivers.where(F.col("rank") <= top_k)
               .agg(F.sort_array(F.collect_list(F.struct("rank", "feature"))).alias("d"))
               .select(F.transform("d", lambda x: F.format_string(
                   "Rank %d: %s", x["rank"], driver_name(x["feature"])))
                   .alias("top_drivers")))
        rec = with_scalars(rec, top)
    return rec
