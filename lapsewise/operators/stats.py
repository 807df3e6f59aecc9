"""Exact quantiles without moving raw rows, in two scans.

1. A mergeable rank sketch (KLL) of every column and group gives, for each
   order statistic wanted, a bracket of two values around it.
2. One scan counts the values below each bracket and keeps, with their counts,
   the few inside it (about 2·SLACK of the rows); that table is written. The
   counts prove whether a bracket holds its ranks; should one not, it is widened
   to the whole range and its column is scanned again.

Inside the brackets an order statistic is found by narrowing: the range that
holds it is cut into equal parts, one map-side combined count (with each
part's least and largest value) tells in which part it lies, and that part's
own range is the next one, until it is a single value. Sketches, counts and
ranges are a row for each column, group and quantile. The same steps run at
every size. Values between two order statistics are interpolated linearly, as
pandas and NumPy do.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from lapsewise.session import materialize

#: Parts that a range is cut into on each pass.
PARTS = 4096
#: Size of a sketch (its ranks err by about 0.2 % of the rows), and the ranks a bracket adds on each side.
SKETCH, SLACK = 2000, 0.004
_LARGEST = 1.7976931348623157e308


def _narrow(long: DataFrame, keys: list[str], targets: list[dict], parts: int) -> list[dict]:
    """One pass over values ``x`` with counts ``w``: each open target's range becomes that of the part
    that holds its rank."""
    spark = long.sparkSession
    fields = [long.schema[k] for k in keys] + [
        StructField("rank", LongType()), StructField("lo", DoubleType()), StructField("hi", DoubleType())]
    rows = [tuple(t[f.name] for f in fields) for t in targets]
    ranges = F.broadcast(spark.createDataFrame(rows, StructType(fields)))
    on = [long[k].eqNullSafe(ranges[k]) for k in keys]
    inside = (long.join(ranges, on).where(long["x"].between(ranges["lo"], ranges["hi"]))
              .select(*[long[k] for k in keys], "rank", "x", "w", "lo", "hi"))
    # halves first, so that the span of the widest range is finite; infinities are the outer parts
    bounded = [F.greatest(F.least(F.col(c), F.lit(_LARGEST)), F.lit(-_LARGEST)) / 2 for c in ("x", "lo", "hi")]
    span = bounded[2] - bounded[1]
    part = F.when(F.col("x") == F.col("lo"), F.lit(0)).when(F.col("x") == F.col("hi"), F.lit(parts - 1)).when(
        span > 0, F.least(F.floor((bounded[0] - bounded[1]) / span * parts), F.lit(parts - 1))).otherwise(0)
    counts = inside.groupBy(*keys, "rank", part.cast("int").alias("part")).agg(
        F.sum("w").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    # at most PARTS rows for each key and rank
    before = Window.partitionBy(*keys, "rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("skip", F.coalesce(F.sum("c").over(before), F.lit(0)))
    below = {tuple(t[k] for k in [*keys, "rank"]): t["below"] for t in targets}
    need = F.broadcast(spark.createDataFrame(
        [(*k, k[-1] - v) for k, v in below.items()],
        StructType([long.schema[k] for k in keys] + [StructField("rank", LongType()),
                                                     StructField("need", LongType())])))
    hit = (placed.join(need, [placed[k].eqNullSafe(need[k]) for k in keys] + [placed["rank"] == need["rank"]])
           .where((F.col("skip") <= F.col("need")) & (F.col("need") < F.col("skip") + F.col("c")))
           .select(*[placed[k] for k in keys], placed["rank"], "lo", "hi", "skip"))
    out = []
    for r in hit.collect():                     # one row for each target
        key = tuple(r[k] for k in [*keys, "rank"])
        out.append({**{k: r[k] for k in [*keys, "rank", "lo", "hi"]}, "below": below[key] + r["skip"]})
    return out


def _number(col: str):
    """A column as a double, NaN as null."""
    x = F.col(f"`{col}`").cast("double")
    return F.when(~F.isnan(x), x)


def _brackets(df: DataFrame, cols: Sequence[str], qs: Sequence[float], by: str | None) -> list[dict]:
    """First scan: name, by, q, n, the two ranks around q, and values lo ≤ those ranks ≤ hi (nearly surely)."""
    aggs = []
    for i, c in enumerate(cols):
        x = _number(c)
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"),
                 F.kll_sketch_agg_double(x, F.lit(SKETCH)).alias(f"s{i}")]
    sketched = (df.groupBy(F.col(by)) if by else df.groupBy()).agg(*aggs)
    told = []
    for i, c in enumerate(cols):
        n = F.col(f"n{i}")
        for q in qs:
            # a sketch takes constant ranks; of few rows all values are kept
            few = n * SLACK < 4
            low, high = (F.kll_sketch_get_quantile_double(F.col(f"s{i}"), F.lit(r))
                         for r in (max(q - SLACK, 0.0), min(q + SLACK, 1.0)))
            told.append(F.when(n > 0, F.struct(
                F.lit(c).alias("name"), F.lit(float(q)).alias("q"), n.alias("n"),
                (F.col(f"a{i}") if q <= SLACK else F.when(few, F.col(f"a{i}")).otherwise(low)).alias("lo"),
                (F.col(f"b{i}") if q >= 1 - SLACK else F.when(few, F.col(f"b{i}")).otherwise(high)).alias("hi"),
                F.col(f"a{i}").alias("least"), F.col(f"b{i}").alias("most"))))
    rows = sketched.select(*([F.col(by)] if by else []), F.explode(F.array_compact(F.array(*told))).alias("t")) \
        .select(*([by] if by else []), "t.*").collect()         # one row for each column, group and quantile
    out = []
    for r in rows:
        pos = (r["n"] - 1) * r["q"]
        out.append({**r.asDict(), "pos": pos, "ranks": sorted({math.floor(pos), math.ceil(pos)})})
    return out


def _inside(df: DataFrame, targets: list[dict], by: str | None) -> DataFrame:
    """Second scan: (t, x, w): how often a value inside the bracket of target t stands there; x null: below it."""
    spark = df.sparkSession
    places = {c: [t for t in targets if t["name"] == c] for c in {t["name"] for t in targets}}
    if by is None:
        bounds = {c: [(F.lit(t["t"]), F.lit(t["lo"]), F.lit(t["hi"])) for t in own] for c, own in places.items()}
        rows = df
    else:
        # one row a group: the brackets of all its targets
        kinds = sorted({(t["name"], t["q"]) for t in targets})
        groups: dict = {}
        for t in targets:
            groups.setdefault(t[by], {})[(t["name"], t["q"])] = t
        fields = [StructField("__by", df.schema[by].dataType)]
        for i in range(len(kinds)):
            fields += [StructField(f"__t{i}", LongType()), StructField(f"__lo{i}", DoubleType()),
                       StructField(f"__hi{i}", DoubleType())]
        table = spark.createDataFrame([(g, *[v for k in kinds for v in (
            (own[k]["t"], own[k]["lo"], own[k]["hi"]) if k in own else (None, None, None))])
            for g, own in groups.items()], StructType(fields))
        rows = df.join(F.broadcast(table), df[by].eqNullSafe(table["__by"]))
        bounds = {}
        for i, (c, _) in enumerate(kinds):
            bounds.setdefault(c, []).append((F.col(f"__t{i}"), F.col(f"__lo{i}"), F.col(f"__hi{i}")))
    found = [F.when(_number(c) <= hi, F.struct(t.cast("long").alias("t"),
                                               F.when(_number(c) >= lo, _number(c)).alias("x")))
             for c, own in bounds.items() for t, lo, hi in own]
    return (rows.select(F.explode(F.array_compact(F.array(*found))).alias("f"))
            .groupBy("f.t", "f.x").agg(F.count(F.lit(1)).alias("w")))


def exact_quantiles_multi(df: DataFrame, cols: Sequence[str], qs: Sequence[float],
                          by: str | None = None, parts: int = PARTS) -> DataFrame:
    """``(name[, by], q, value)``: exact quantiles of several columns, for each group of ``by``.

    ``by`` is a column of few groups: the collected and broadcast state is a
    row for each column, group and quantile. NULL and NaN do not count.
    """
    keys = ["name"] + ([by] if by else [])
    spark = df.sparkSession
    targets = [{**t, "t": i} for i, t in enumerate(_brackets(df, cols, qs, by))]
    open_, kept = targets, None
    while open_:
        found = materialize(_inside(df, open_, by))
        told = {r["t"]: r for r in found.groupBy("t").agg(
            F.sum(F.when(F.col("x").isNull(), F.col("w")).otherwise(0)).alias("below"), F.sum("w").alias("upto"),
            F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
        failed = []
        for t in open_:
            r = told.get(t["t"])
            if r is not None and r["below"] <= t["ranks"][0] and t["ranks"][-1] < r["upto"]:
                t.update(below=r["below"], lo=r["lo"], hi=r["hi"], done=True)
            else:                               # the sketch erred by more than SLACK
                t.update(lo=t["least"], hi=t["most"])
                failed.append(t)
        good = found.where(F.col("x").isNotNull() & ~F.col("t").isin([t["t"] for t in failed]))
        kept = good if kept is None else kept.unionByName(good)
        open_ = failed
    state = {(t["t"], rank): {"t": t["t"], "rank": rank, "lo": t["lo"], "hi": t["hi"], "below": t["below"]}
             for t in targets for rank in t["ranks"]}
    while wide := [v for v in state.values() if v["lo"] < v["hi"]]:
        for v in _narrow(kept, ["t"], wide, parts):
            state[v["t"], v["rank"]] = v
    rows = []
    for t in targets:
        v1, v2 = (state[t["t"], rank]["lo"] for rank in (t["ranks"][0], t["ranks"][-1]))
        value = v1 if v1 == v2 else v1 + (v2 - v1) * (t["pos"] - t["ranks"][0])
        rows.append((*[t[k] for k in keys], t["q"], value))
    schema = StructType([StructField("name", StringType()), *([df.schema[by]] if by else []),
                         StructField("q", DoubleType()), StructField("value", DoubleType())])
    return spark.createDataFrame(rows, schema)


def exact_quantiles_long(df: DataFrame, cols: Sequence[str], q: float = 0.5,
                         by: str | None = None) -> DataFrame:
    """``(name[, by], value)``: exact linear-interpolated ``q`` quantile per column
    (per group with ``by``)."""
    return exact_quantiles_multi(df, cols, [q], by).drop("q")


def exact_quantiles(df: DataFrame, cols: Sequence[str], q: float = 0.5) -> DataFrame:
    """One row, one column per input column: the exact ``q`` quantile (NULL if no values)."""
    long = exact_quantiles_long(df, cols, q)
    return long.groupBy().agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in cols])


def exact_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return exact_quantiles(df, cols, 0.5)
