"""Scalar expressions shared by the operators.

All of them are built-in Catalyst expressions, so they stay inside whole-stage
codegen. They encode the null rules of the reference (pandas semantics):

* a comparison with a missing value is False, not NULL (``is_true``);
* a ratio with a zero/missing denominator is missing (``safe_div``);
* month arithmetic keeps time of day and clamps month ends (``months_before``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000.0


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def days_between(end, start) -> Column:
    """Fractional days from ``start`` to ``end`` (F-1); NULL if either is NULL."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(MICROS_PER_DAY)


def months_before(ts, months: int) -> Column:
    """``ts`` minus ``months`` calendar months, time of day kept (F-2).

    ``add_months`` would drop the time of day; a year-month interval keeps it
    and clamps the day to the end of a shorter month (31 Aug - 6 = 28/29 Feb).
    """
    return _c(ts) - F.make_ym_interval(F.lit(0), F.lit(int(months)))


def is_true(cond: Column) -> Column:
    """pandas comparison rule: missing compares False (F-6)."""
    return F.coalesce(cond, F.lit(False))


def non_blank(col) -> Column:
    """Not NULL and holding at least one non-whitespace character (P-4, F-4).

    ``trim`` only removes spaces, so tab/newline-only text would count as
    text; a Unicode-aware ``\\S`` test matches Python's ``str.strip`` rule.
    """
    return F.coalesce(_c(col).rlike(r"(?U)\S"), F.lit(False))


def safe_div(num, den) -> Column:
    """``num / den`` when ``den > 0`` else NULL (P-9, F-5); ANSI-safe."""
    den = _c(den)
    return F.when(is_true(den > 0), _c(num) / den)


def r6(col) -> Column:
    """Round a double to six decimals for compared outputs (F-8)."""
    return F.round(_c(col).cast("double"), 6)


def hash_unit(key, seed: int = 42) -> Column:
    """Deterministic draw in [0, 1) from ``md5(seed:key)``.

    Independent of partitioning and of task retries (unlike ``rand``), and the
    same value in DuckDB: ``('0x'||substr(md5(k),1,8))::BIGINT / 2^32``.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_key(key, seed: int = 42) -> Column:
    """The full md5 hex digest of ``seed:key``: a total order for seeded draws."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string")))


def fmt_pct(col, decimals: int = 1) -> Column:
    """``0.123`` → ``'12.3%'`` (F-9)."""
    return F.format_string(f"%.{decimals}f%%", _c(col) * F.lit(100.0))
