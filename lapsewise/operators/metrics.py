"""Classification metrics, curves and thresholds (M-1, M-2, M-5 … M-14, M-19, A-11).

Input: a scored DataFrame with an integer ``label`` (1 = churned) and a
churn probability column. Everything is a distributed aggregation:

* counts per distinct score are combined map-side;
* running totals over the score order (ROC/PR curves, exact AUC) never use a
  window without partitioning over all distinct scores: scores are dealt to
  buckets by rank (range partitions), bucket totals give each bucket's offset
  (a window over one row a bucket), and the running sum inside a bucket is a
  window partitioned by bucket;
* the 91-threshold sweep maps every row once to the number of grid values
  ≤ its score (exact double comparisons with the grid values NumPy's
  ``arange(0.05, 0.96, 0.01)`` produces); running sums over those ≤ 92
  bucket counts give every threshold's confusion counts in one pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.functions.exprs import r6
from lapsewise.operators.joins import with_scalars
from lapsewise.session import materialize

LABEL = "label"
PROB = "p_churn"

# Grid of the F1 sweep: NumPy's arange values (91 doubles, generated by rule).
THRESHOLD_GRID = [float(t) for t in np.arange(0.05, 0.96, 0.01)]


def _div(a, b):
    """a / b, 0.0 when b == 0 (scikit-learn's zero_division=0)."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


# --- class balance ------------------------------------------------------------------

def class_distribution(df: DataFrame, label: str = LABEL, by: str | None = None) -> DataFrame:
    """A-11: ``([by,] label, n, share)``."""
    keys = ([by] if by else []) + [label]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*([by] if by else []))
    return counts.withColumn("share", r6(F.col("n") / F.sum("n").over(w)))


def scale_pos_weight(df: DataFrame, label: str = LABEL) -> DataFrame:
    """M-1: n(label=0) / n(label=1); NULL when there is no positive row."""
    return df.agg(F.count(F.when(F.col(label) == 0, 1)).alias("n_retained"),
                  F.count(F.when(F.col(label) == 1, 1)).alias("n_churned")) \
        .withColumn("scale_pos_weight", F.try_divide(F.col("n_retained").cast("double"),
                                                     F.col("n_churned").cast("double")))


# --- confusion-based metrics -----------------------------------------------------

def confusion_matrix(scored: DataFrame, threshold: float = 0.5, label: str = LABEL,
                     prob: str = PROB) -> DataFrame:
    """M-7: ``(actual, predicted, n)`` with predicted = ``prob >= threshold``."""
    pred = (F.col(prob) >= F.lit(float(threshold))).cast("int")
    return scored.groupBy(F.col(label).cast("int").alias("actual"), pred.alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n"))


def _confusion_row(scored: DataFrame, pred, label: str) -> DataFrame:
    y = F.col(label)
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when((y == 1) & (pred == 1), 1)).alias("tp1"),
        F.count(F.when((y == 0) & (pred == 1), 1)).alias("fp1"),
        F.count(F.when((y == 0) & (pred == 0), 1)).alias("tn1"),
        F.count(F.when((y == 1) & (pred == 0), 1)).alias("fn1"))


def _class_metrics(pos: int):
    """precision/recall/f1 for class ``pos`` from the tp1/fp1/tn1/fn1 columns."""
    if pos == 1:
        tp, fp, fn = F.col("tp1"), F.col("fp1"), F.col("fn1")
    else:
        tp, fp, fn = F.col("tn1"), F.col("fn1"), F.col("fp1")
    return (_div(tp, tp + fp), _div(tp, tp + fn), _div(2 * tp, 2 * tp + fp + fn))


def classification_metrics(scored: DataFrame, threshold: float = 0.5, label: str = LABEL,
                           prob: str = PROB) -> DataFrame:
    """M-5: accuracy; precision/recall/F1 of the retained (0) and churned (1) class;
    ROC-AUC of the churn score; the threshold."""
    pred = (F.col(prob) >= F.lit(float(threshold))).cast("int")
    cm = _confusion_row(scored, pred, label)
    p0, r0, f0 = _class_metrics(0)
    p1, r1, f1 = _class_metrics(1)
    out = cm.select(_div(F.col("tp1") + F.col("tn1"), F.col("rows")).alias("accuracy"),
                    p0.alias("precision"), r0.alias("recall"), f0.alias("f1"),
                    p1.alias("precision_churned"), r1.alias("recall_churned"),
                    f1.alias("f1_churned"))
    return with_scalars(out, roc_auc(scored, label, prob)) \
        .withColumn("threshold", F.lit(float(threshold)))


def majority_baseline(train: DataFrame, test: DataFrame, label: str = LABEL) -> DataFrame:
    """M-2: predict the training majority class with a constant score, evaluate on test."""
    major = train.groupBy(label).agg(F.count(F.lit(1)).alias("n")) \
        .agg(F.max_by(label, F.struct("n", F.col(label))).alias("__major"))
    scored = with_scalars(test, major) \
        .withColumn(PROB, F.col("__major").cast("double")).drop("__major")
    return classification_metrics(scored, 0.5, label, PROB)


# --- running totals over the score order -----------------------------------------

def score_counts(scored: DataFrame, label: str = LABEL, score: str = PROB,
                 positive: int = 1) -> DataFrame:
    """``(score, pos, neg)`` per distinct score (map-side combined)."""
    y = F.col(label)
    return (scored.where(F.col(score).isNotNull())
            .groupBy(F.col(score).alias("score"))
            .agg(F.count(F.when(y == positive, 1)).alias("pos"),
                 F.count(F.when(y != positive, 1)).alias("neg")))


def running_totals(counts: DataFrame, descending: bool = True,
                   buckets: int | None = None) -> DataFrame:
    """Adds ``cum_pos``/``cum_neg``: totals over scores at or before each score.

    Order is descending (ROC: predict positive when score ≥ s) or ascending.
    """
    order = F.col("score").desc() if descending else F.col("score").asc()
    # ranges by rank (Spark samples the scores), so no bucket holds much more than others;
    # written once, as the bucket of a row must not change between its two uses
    ranged = counts.repartitionByRange(buckets, order) if buckets else counts.repartitionByRange(order)
    c = materialize(ranged.withColumn("__b", F.spark_partition_id()))
    per_bucket = c.groupBy("__b").agg(F.sum("pos").alias("__bp"), F.sum("neg").alias("__bn"))
    # one row a bucket in this window and in the broadcast
    wb = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("__b", F.coalesce(F.sum("__bp").over(wb), F.lit(0)).alias("__op"),
                                F.coalesce(F.sum("__bn").over(wb), F.lit(0)).alias("__on"))
    wi = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (c.join(F.broadcast(offsets), "__b")
            .withColumn("cum_pos", F.col("__op") + F.sum("pos").over(wi))
            .withColumn("cum_neg", F.col("__on") + F.sum("neg").over(wi))
            .drop("__b", "__op", "__on"))


def _totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))


def roc_auc(scored: DataFrame, label: str = LABEL, prob: str = PROB) -> DataFrame:
    """M-6: exact, tie-corrected ROC-AUC of ``prob`` for class 1 (one row ``roc_auc``).

    AUC = Σ_s pos(s)·(neg below s + neg(s)/2) / (P·N); NULL for a single class.
    """
    counts = score_counts(scored, label, prob)
    rt = with_scalars(running_totals(counts, descending=True), _totals(counts))
    term = F.col("pos") * (F.col("N") - F.col("cum_neg") + F.col("neg") * F.lit(0.5))
    return rt.agg(F.sum(term).alias("__s"), F.first("P").alias("P"), F.first("N").alias("N")) \
        .select(F.when((F.col("P") > 0) & (F.col("N") > 0),
                       F.col("__s") / (F.col("P") * F.col("N"))).alias("roc_auc"))


def roc_curve(scored: DataFrame, label: str = LABEL, prob: str = PROB) -> DataFrame:
    """M-10: ``(threshold, fpr, tpr)`` at every distinct score plus the (+inf, 0, 0) start."""
    counts = score_counts(scored, label, prob)
    rt = with_scalars(running_totals(counts, descending=True), _totals(counts))
    pts = rt.select(F.col("score").alias("threshold"),
                    _div(F.col("cum_neg"), F.col("N")).alias("fpr"),
                    _div(F.col("cum_pos"), F.col("P")).alias("tpr"))
    start = scored.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"),
                                                F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def youden_threshold(scored: DataFrame, label: str = LABEL, prob: str = PROB) -> DataFrame:
    """M-13: threshold maximising tpr − fpr; ties → the highest threshold."""
    roc = roc_curve(scored, label, prob).withColumn("j", F.col("tpr") - F.col("fpr"))
    return roc.agg(F.max_by(F.struct("threshold", "fpr", "tpr", "j"),
                            F.struct("j", "threshold")).alias("b")).select("b.*")


def pr_curve(scored: DataFrame, label: str = LABEL, prob: str = PROB,
             retained: bool = True) -> DataFrame:
    """M-9: precision/recall/F1 per distinct threshold of the retained score 1 − p
    (``retained=True``, positive = label 0) or of p (positive = label 1)."""
    score = (F.lit(1.0) - F.col(prob)) if retained else F.col(prob)
    s = scored.select(F.col(label), score.alias("__score"))
    counts = score_counts(s, label, "__score", positive=0 if retained else 1)
    rt = with_scalars(running_totals(counts, descending=True), _totals(counts))
    precision = _div(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    recall = F.when(F.col("P") > 0, F.col("cum_pos") / F.col("P")).otherwise(F.lit(1.0))
    return rt.select(F.col("score").alias("threshold"), precision.alias("precision"),
                     recall.alias("recall")) \
        .withColumn("f1", _div(2 * F.col("precision") * F.col("recall"),
                               F.col("precision") + F.col("recall")))


def pr_threshold(scored: DataFrame, label: str = LABEL, prob: str = PROB) -> DataFrame:
    """M-12: F1-optimal threshold on the retained PR curve; ties → the lowest threshold."""
    pr = pr_curve(scored, label, prob, retained=True)
    return pr.agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"),
                           F.struct(F.col("f1"), -F.col("threshold"))).alias("b")).select("b.*")


def no_skill(scored: DataFrame, label: str = LABEL) -> DataFrame:
    """M-14: share of retained rows (the PR baseline)."""
    return scored.agg(F.avg((F.col(label) == 0).cast("double")).alias("no_skill"))


def threshold_grid(scored: DataFrame, label: str = LABEL, prob: str = PROB,
                   grid=THRESHOLD_GRID) -> DataFrame:
    """M-11 table: retained-class precision/recall/F1 at each grid threshold, one pass."""
    arr = F.array(*[F.lit(t) for t in grid])
    cnt = F.size(F.filter(arr, lambda t: t <= F.col(prob)))
    # per bucket c (number of grid values ≤ p): retained / churned rows
    counts = (scored.groupBy(cnt.alias("j"))
              .agg(F.count(F.when(F.col(label) == 0, 1)).alias("n0"),
                   F.count(F.when(F.col(label) != 0, 1)).alias("n1")))
    spark = scored.sparkSession
    g = spark.createDataFrame([(j, t) for j, t in enumerate(grid)], "j int, threshold double")
    # p < t_j  <=>  c ≤ j: TP/FP at threshold j are running sums of buckets 0..j
    # (a window over the 91 grid rows only)
    w = Window.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    sums = (g.join(counts, "j", "left").na.fill(0, ["n0", "n1"])
            .withColumn("tp", F.sum("n0").over(w)).withColumn("fp", F.sum("n1").over(w)))
    total0 = scored.agg(F.count(F.when(F.col(label) == 0, 1)).alias("pos"))
    agg = with_scalars(sums, total0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("pos") - F.col("tp")
    return agg.select("j", "threshold", _div(tp, tp + fp).alias("precision"),
                      _div(tp, tp + fn).alias("recall"),
                      _div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def best_grid_threshold(scored: DataFrame, label: str = LABEL, prob: str = PROB) -> DataFrame:
    """M-11: grid threshold with the highest retained-class F1 (strictly better wins,
    so the lowest among ties); 0.5 with zeros when every F1 is 0."""
    grid = threshold_grid(scored, label, prob)
    best = grid.agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"),
                             F.struct(F.col("f1"), -F.col("j"))).alias("b")).select("b.*")
    none = F.col("f1") <= 0
    return best.select(F.when(none, F.lit(0.5)).otherwise(F.col("threshold")).alias("threshold"),
                       F.when(none, F.lit(0.0)).otherwise(F.col("precision")).alias("precision"),
                       F.when(none, F.lit(0.0)).otherwise(F.col("recall")).alias("recall"),
                       F.when(none, F.lit(0.0)).otherwise(F.col("f1")).alias("f1"))


def top_decile(scored: DataFrame, prob: str = PROB, q: float = 0.9) -> DataFrame:
    """M-19: rows whose retention probability 1 − p is at or above its exact q-quantile."""
    from lapsewise.operators.stats import exact_quantiles
    s = scored.withColumn("p_retained", F.lit(1.0) - F.col(prob))
    cut = exact_quantiles(s, ["p_retained"], q).select(F.col("p_retained").alias("__cut"))
    return with_scalars(s, cut).where(F.col("p_retained") >= F.col("__cut")).drop("__cut")
