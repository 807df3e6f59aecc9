"""Column-level helpers (scalar functions F-1 … F-13 and null-rule wrappers)."""

from lapsewise.functions.exprs import (  # noqa: F401
    days_between,
    fmt_pct,
    hash_unit,
    is_true,
    months_before,
    non_blank,
    r6,
    safe_div,
)
