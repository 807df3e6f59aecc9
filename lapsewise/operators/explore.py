"""Exploratory aggregates (A-13 … A-28, P-3, P-5, P-10, P-11, P-14, T-2, T-3, W-2).

All are grouped aggregations that combine map-side; where a per-group
statistic needs a second pass (shares of a group total, quantile caps,
histogram ranges) the per-group row is tiny and joined back (bounded by the
number of groups, which is a handful of segments here).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.functions.exprs import is_true, non_blank, r6
from lapsewise.operators.orders import earliest_per_key
from lapsewise.operators.stats import exact_quantiles_long, exact_quantiles_multi

SEGMENT = "segment"


def segment_col(flag: str = "churned"):
    """P-14: True/False → 'Churned'/'Retained' (NULL stays NULL)."""
    return F.when(F.col(flag), F.lit("Churned")).when(~F.col(flag), F.lit("Retained"))


def with_segment(df: DataFrame, flag: str = "churned") -> DataFrame:
    return df.withColumn(SEGMENT, segment_col(flag))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A-13: ``(col, n)`` over non-NULL values."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def score_share_by_segment(df: DataFrame, score: str = "review_score") -> DataFrame:
    """A-14 / W-4: share of each score within its segment (rows without a score dropped)."""
    counts = (with_segment(df).na.drop(subset=[score])
              .groupBy(SEGMENT, score).agg(F.count(F.lit(1)).alias("n")))
    # the window runs over (segments × scores) rows only
    total = F.sum("n").over(Window.partitionBy(SEGMENT))
    return counts.withColumn("proportion", r6(F.col("n") / total))


def score_share_pivot(df: DataFrame, score: str = "review_score") -> DataFrame:
    """A-15: score × segment proportions, one column per segment."""
    return (score_share_by_segment(df, score).groupBy(score)
            .pivot(SEGMENT, ["Churned", "Retained"]).agg(F.first("proportion")))


def punctuality(df: DataFrame, status: str = "delivered",
                delay: str = "delivery_delay_days") -> DataFrame:
    """A-22 (+P-3): delivered rows, rows with a delay, late/early counts and shares.

    Shares divide by all delivered rows: a missing delay counts as neither
    late nor early but stays in the denominator (pandas boolean mean).
    """
    d = df.where(F.col("order_status") == status)
    late = is_true(F.col(delay) > 0).cast("int")
    early = is_true(F.col(delay) <= 0).cast("int")
    return d.agg(F.count(F.lit(1)).alias("delivered_rows"),
                 F.count(delay).alias("rows_with_delay"),
                 F.sum(late).cast("bigint").alias("late_n"),
                 r6(F.avg(late)).alias("late_share"),
                 F.sum(early).cast("bigint").alias("early_n"),
                 r6(F.avg(early)).alias("early_share"))


def median_by_segment(df: DataFrame, value: str) -> DataFrame:
    """A-17: exact median of ``value`` per segment."""
    q = exact_quantiles_long(with_segment(df).where(F.col(SEGMENT).isNotNull()), [value], 0.5,
                             by=SEGMENT)
    return q.select(SEGMENT, F.col("value").alias(f"median_{value}"))


def describe_by_segment(df: DataFrame, value: str = "payment_value") -> DataFrame:
    """A-19: count, mean, sample std, min, exact 25/50/75 %, max per segment."""
    seg = with_segment(df).where(F.col(SEGMENT).isNotNull())
    base = seg.groupBy(SEGMENT).agg(F.count(value).alias("count"), F.avg(value).alias("mean"),
                                    F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
                                    F.max(value).alias("max"))
    qs = (exact_quantiles_multi(seg, [value], [0.25, 0.5, 0.75], by=SEGMENT)
          .groupBy(SEGMENT).agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(nm)
                                  for q, nm in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]))
    return (base.join(qs, SEGMENT, "left")
            .select(SEGMENT, "count", "mean", "std", "min", "p25", "p50", "p75", "max"))


def clip_to_group_quantile(df: DataFrame, value: str, q: float = 0.99, lower: float = 0.0,
                           by: str = SEGMENT) -> DataFrame:
    """P-11: ``value`` clipped to [lower, per-group exact q-quantile] (NULL values dropped)."""
    d = df.na.drop(subset=[value])
    cap = exact_quantiles_long(d, [value], q, by=by).select(by, F.col("value").alias("__cap"))
    # one row a group of a low-cardinality column: the rows themselves are not exchanged
    return (d.join(F.broadcast(cap), by, "left")
            .withColumn(value, F.greatest(F.least(F.col(value), F.col("__cap")), F.lit(lower)))
            .drop("__cap"))


def clip_range(df: DataFrame, value: str, lo: float, hi: float) -> DataFrame:
    """P-10: fixed-range clip."""
    return df.withColumn(value, F.greatest(F.least(F.col(value), F.lit(hi)), F.lit(lo)))


def histogram(df: DataFrame, value: str, by: str = SEGMENT, bins: int = 60) -> DataFrame:
    """A-26: equal-width histogram per group over that group's [min, max], with density.

    Bin i holds lo + i·w ≤ x < lo + (i+1)·w, the maximum falls in the last
    bin; a constant group uses [x−0.5, x+0.5] (NumPy's rule).
    density = n / (group total · width).
    """
    d = df.where(F.col(value).isNotNull() & F.col(by).isNotNull())
    rng = (d.groupBy(by).agg(F.min(value).alias("mn"), F.max(value).alias("mx"),
                             F.count(F.lit(1)).alias("total"))
           .select(by, "total",
                   F.when(F.col("mx") > F.col("mn"), F.col("mn")).otherwise(F.col("mn") - 0.5)
                   .alias("lo"),
                   F.when(F.col("mx") > F.col("mn"), F.col("mx")).otherwise(F.col("mx") + 0.5)
                   .alias("hi")))
    idx = F.least(F.greatest(F.floor((F.col(value) - F.col("lo")) * F.lit(float(bins))
                                     / (F.col("hi") - F.col("lo"))), F.lit(0)), F.lit(bins - 1))
    # ranges: one row a group of a low-cardinality column; counts combine map-side
    counts = (d.join(F.broadcast(rng), by)
              .groupBy(by, idx.cast("int").alias("bin"))
              .agg(F.count(F.lit(1)).alias("n")))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return (counts.join(rng, by)
            .select(by, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"), "n",
                    (F.col("n") / (F.col("total") * width)).alias("density")))


def density_curve(df: DataFrame, value: str, by: str = SEGMENT, lo: float = -2.0, hi: float = 2.0,
                  cells: int = 512) -> DataFrame:
    """A-27: Gaussian kernel density of ``value`` per group at the ``cells`` + 1 points of a fixed grid.

    Linear binning: a value's weight is dealt to the two grid points around it;
    the densities are then the convolution of these weights with the kernel, of
    Scott's bandwidth s·n^(−1/5). Values are read once (moments and weights in
    one aggregate that combines map-side); the convolution works on grid points,
    (cells + 1)² terms a group however many rows. The grid is a parameter: values
    outside it are counted at its ends, and it should reach a few bandwidths
    beyond them. Groups of fewer than two values, or of one repeated value,
    have no density; nulls do not take part.
    """
    step = (hi - lo) / cells
    x = F.least(F.greatest(F.col(value).cast("double"), F.lit(lo)), F.lit(hi))
    at = (x - F.lit(lo)) / F.lit(step)
    left = F.least(F.floor(at), F.lit(cells - 1)).cast("int")
    ends = F.array(F.struct(left.alias("j"), (1.0 - (at - left)).alias("w"), x.alias("x")),
                   F.struct((left + 1).alias("j"), (at - left).alias("w"), F.lit(None).cast("double").alias("x")))
    binned = (df.where(F.col(value).isNotNull() & F.col(by).isNotNull())
              .select(by, F.explode(ends).alias("e")).groupBy(by, "e.j")
              .agg(F.sum("e.w").alias("w"), F.count("e.x").alias("n"), F.sum("e.x").alias("s"),
                   F.sum(F.col("e.x") * F.col("e.x")).alias("q")))
    group = Window.partitionBy(by)              # at most cells + 1 rows a group
    n, s = F.sum("n").over(group), F.sum("s").over(group)
    var = (F.sum("q").over(group) - s * s / n) / (n - 1)
    known = (binned.withColumns({"total": n, "var": F.when(n > 1, var)})
             .where(F.col("var") > 1e-12)
             .withColumn("h", F.sqrt("var") * F.pow(F.col("total"), F.lit(-0.2))))
    z = (F.lit(step) * (F.col("i") - F.col("j"))) / F.col("h")
    return (known.select(by, "j", "w", "total", "h", F.explode(F.sequence(F.lit(0), F.lit(cells))).alias("i"))
            .groupBy(by, "i").agg(F.sum(F.col("w") * F.exp(-0.5 * z * z) / (F.col("total") * F.col("h")
                                                                            * math.sqrt(2 * math.pi))).alias("density"))
            .select(by, (F.lit(lo) + F.col("i") * F.lit(step)).alias("x"), "density"))


def customer_first_order(df: DataFrame, customer: str = "customer_unique_id",
                         ts: str = "order_purchase_timestamp") -> DataFrame:
    """W-2: each customer's earliest order (ties by order id, undated last)."""
    return earliest_per_key(df, customer, ts, "order_id")


def state_churn(df: DataFrame, state: str = "customer_state") -> DataFrame:
    """A-23: customers (state of their first order), churned customers, rate per state."""
    first = customer_first_order(df.select("customer_unique_id", "order_id",
                                           "order_purchase_timestamp", state, "churned"))
    return (first.groupBy(state)
            .agg(F.count("customer_unique_id").alias("total_customers"),
                 F.sum(F.col("churned").cast("int")).cast("bigint").alias("churned_customers"))
            .withColumn("churn_rate", r6(F.col("churned_customers") / F.col("total_customers"))))


def state_churn_topk(df: DataFrame, min_customers: int = 100, k: int = 10) -> DataFrame:
    """T-2: states with at least ``min_customers``, the ``k`` highest churn rates."""
    return (state_churn(df).where(F.col("total_customers") >= min_customers)
            .orderBy(F.col("churn_rate").desc(), F.col("customer_state")).limit(k))


def category_churn(df: DataFrame, top: list[str], cat: str = "product_category_english") -> DataFrame:
    """A-24: churn rate and order count per top category, highest rate first."""
    return (df.where(is_true(F.col(cat).isin(top)))
            .groupBy(F.col(cat).alias("category"))
            .agg(r6(F.avg(F.col("churned").cast("double"))).alias("churn_rate"),
                 F.count("churned").alias("order_count"))
            .orderBy(F.col("churn_rate").desc(), F.col("category")))


def text_coverage(df: DataFrame, text: str = "review_comment_message") -> DataFrame:
    """A-25: rows, rows with non-blank text, share, rows without."""
    has = non_blank(text).cast("int")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(has).cast("bigint").alias("with_text"),
                  r6(F.avg(has)).alias("text_share"),
                  F.sum(1 - has).cast("bigint").alias("without_text"))


def rate_by_segment(df: DataFrame, flag_or_value, name: str) -> DataFrame:
    """A-16: mean of a flag/value per segment."""
    return (with_segment(df).where(F.col(SEGMENT).isNotNull()).groupBy(SEGMENT)
            .agg(r6(F.avg(flag_or_value.cast("double"))).alias(name)))


def distinct_levels(df: DataFrame, cols=("payment_type", "customer_state",
                                         "product_category_english")) -> DataFrame:
    """A-28: number of distinct non-NULL levels per categorical column."""
    wide = df.agg(*[F.countDistinct(c).alias(c) for c in cols])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("levels")) for c in cols]))
        .alias("p")).select("p.*")
