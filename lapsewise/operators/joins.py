"""Join helper that keeps the left table's column order (and pandas null-key matching)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def left_attach(df: DataFrame, other: DataFrame, key: str, how: str = "left",
                null_safe: bool = False) -> DataFrame:
    """``df ⟕ other`` on ``key``; result keeps ``df``'s columns first, in order.

    ``null_safe`` reproduces pandas ``merge``, which matches missing keys with
    missing keys (§1.4 #7).
    """
    rkey = f"__rk_{key}"
    right = other.withColumnRenamed(key, rkey)
    cond = df[key].eqNullSafe(right[rkey]) if null_safe else df[key] == right[rkey]
    out = df.join(right, cond, how)
    extra = [c for c in right.columns if c != rkey]
    return out.select(*[df[c] for c in df.columns], *[right[c] for c in extra])


def with_scalars(df: DataFrame, one_row: DataFrame, cols=None, prefix: str = "") -> DataFrame:
    """Attach the columns of a one-row DataFrame (a global aggregate) as scalar subqueries.

    Each value is computed once before the main plan runs (Spark merges scalar
    subqueries over the same plan) and inlined; no join, no row multiplication.
    """
    from pyspark.sql import functions as F
    cols = list(cols or one_row.columns)
    return df.withColumns({prefix + c: one_row.select(F.col(c)).scalar() for c in cols})
