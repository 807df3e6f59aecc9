"""Seeded draws and the stratified hold-out split (T-6, T-7, E-7).

The split puts in the test fold, for each label, the ``ceil(test_size · n_label)``
rows with the smallest ``md5(seed:key)`` (ties by key): independent of
partitioning and retries, and identical to ranking by that hash per label.

Ranking per label with a window would send each label (two of them, one
holding ~95 % of the rows) to a single task. Instead the cut is found from
counts: rows are bucketed by the first 4 hex digits of the hash (65,536
buckets), the per-(label, bucket) counts give the boundary bucket, a second
level of 4 hex digits narrows it, and only the rows sharing both prefixes with
the cut (about n / 2^32) are ranked individually. The passes read a narrow copy
(label, key, buckets) that is removed behind them, every per-task unit is bounded by
the bucket count, not by the data. The fold is a column of the row and the small
tables of cuts: ``df``'s rows are not exchanged.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.functions.exprs import hash_key, hash_unit
from lapsewise.session import materialize, packed, remove

#: Rows at the cut that are broadcast; more (a key that repeats as often) are joined.
BROADCAST_TIES = 1 << 20


def _level_cut(rows: DataFrame, label: str, bucket: str, need: str) -> DataFrame:
    """Per label: boundary bucket and rows strictly below it, for ``need`` rows."""
    counts = rows.groupBy(label, bucket).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(label).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumn("cum", F.sum("c").over(w))
    return (cum.join(rows.select(label, need).distinct(), label)
            .where(F.col("cum") >= F.col(need))
            .groupBy(label).agg(F.min_by(F.struct(F.col(bucket).alias("b"),
                                                  (F.col("cum") - F.col("c")).alias("below")),
                                         F.col(bucket)).alias("cut"))
            .select(label, F.col("cut.b").alias(f"{bucket}_cut"),
                    F.col("cut.below").alias(f"{bucket}_below")))


def stratified_split(df: DataFrame, label: str = "label", key: str = "order_id",
                     test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """E-7: ``df`` plus ``fold`` ('train'/'test'), exact per-label test counts."""
    h = hash_key(key, seed)
    buckets = {"__b1": F.conv(F.substring(h, 1, 4), 16, 10).cast("int"),
               "__b2": F.conv(F.substring(h, 5, 4), 16, 10).cast("int")}
    # every pass for sizes and cuts reads these few columns only; ``df`` is read twice
    narrow = packed(df.select(label, key, *[c.alias(n) for n, c in buckets.items()]))
    sizes = materialize(narrow.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
                        .withColumn("__need", F.ceil(F.col("__n") * F.lit(float(test_size))).cast("bigint")))
    r = narrow.join(F.broadcast(sizes), label)
    # sizes and cuts hold one row per label (a class column), so they are broadcast and no
    # row is exchanged by its label; materialising them keeps the
    # plan linear (each level would otherwise re-embed all previous levels)
    cut1 = materialize(_level_cut(r.where(F.col("__need") > 0), label, "__b1", "__need"))
    r = r.join(F.broadcast(cut1), label, "left")
    in_b1 = F.col("__b1") == F.col("__b1_cut")
    second = (r.where(in_b1)
              .withColumn("__need2", F.col("__need") - F.col("__b1_below")))
    cut2 = materialize(_level_cut(second, label, "__b2", "__need2"))
    in_b2 = in_b1 & (F.col("__b2") == F.col("__b2_cut"))
    tie = materialize(r.join(F.broadcast(cut2), label, "left").where(in_b2)
           .withColumn("__rk", F.row_number().over(
               Window.partitionBy(label).orderBy(h, key)))
           .where(F.col("__rk") <= F.col("__need") - F.col("__b1_below") - F.col("__b2_below"))
           .select(label, key, F.lit(True).alias("__tie_test")))
    for path in {os.path.dirname(f) for f in narrow.inputFiles()}:
        remove(df.sparkSession, path)
    if tie.count() <= BROADCAST_TIES:
        tie = F.broadcast(tie)
    out = df.withColumns(buckets)
    for per_label in (sizes, cut1, cut2):
        out = out.join(F.broadcast(per_label), label, "inner" if per_label is sizes else "left")
    out = out.join(tie, [label, key], "left")
    is_test = (F.col("__need") > 0) & (
        (F.col("__b1") < F.col("__b1_cut"))
        | (in_b1 & (F.col("__b2") < F.col("__b2_cut")))
        | F.coalesce(F.col("__tie_test"), F.lit(False)))
    return (out.withColumn("fold", F.when(is_test, F.lit("test")).otherwise(F.lit("train")))
            .select(*df.columns, "fold"))


def approx_split(df: DataFrame, key: str = "order_id", test_size: float = 0.2,
                 seed: int = 42) -> DataFrame:
    """Row-local split: test iff ``hash_unit(seed:key) < test_size`` (no shuffle, ≈ size)."""
    return df.withColumn("fold", F.when(hash_unit(key, seed) < test_size, F.lit("test"))
                         .otherwise(F.lit("train")))


def group_split(df: DataFrame, group: str = "customer_unique_id", test_size: float = 0.2,
                seed: int = 42) -> DataFrame:
    """Grouped split: all rows of a customer land in the same fold (no leakage across folds)."""
    return df.withColumn("fold", F.when(hash_unit(group, seed) < test_size, F.lit("test"))
                         .otherwise(F.lit("train")))

