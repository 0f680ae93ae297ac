"""Null-safe scalar column expressions shared by all operators.

Spark's ``greatest``/``least`` skip nulls, so a bare clamp of NULL would
return a bound; every guard here keeps NULL as NULL unless a default is given.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe(c, default: float = 0.0) -> Column:
    """NULL / NaN / +-inf -> default (the reference's safe_float)."""
    x = col(c).cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(x)


def finite_or_null(c) -> Column:
    """NaN and +-inf become NULL: the engine's only missing marker."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)


def clamp(c, lo: float = 0.0, hi: float = 1.0) -> Column:
    """clamp of a value that is already non-null (apply ``safe`` first)."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(c)))


def clamp01(c) -> Column:
    return clamp(safe(c), 0.0, 1.0)


def clip_keep_null(c, lo, hi) -> Column:
    """Series.clip semantics: NULL stays NULL; a NULL bound means unbounded."""
    x = col(c)
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    y = F.when(lo_c.isNotNull() & (x < lo_c), lo_c).otherwise(x)
    y = F.when(hi_c.isNotNull() & (y > hi_c), hi_c).otherwise(y)
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(y)


def div(a, b) -> Column:
    """ANSI-safe division: NULL when the divisor is 0 or NULL."""
    return F.try_divide(col(a), col(b))


def round_half_even(c, digits: int = 1) -> Column:
    """Round like Python's round() on the scaled double (rint of x*10^d)."""
    scale = 10.0 ** digits
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale)


def r6(c) -> Column:
    """Fixed rounding used by every compared float: round(x*1e6 + 1e-4)/1e6.

    Data with few decimals puts exact means on rounding ties, where the last
    bit of a float sum (which depends on summation order) decides the digit;
    the 1e-4 offset moves the boundary off exact decimal ties.  "+ 0.0" turns
    -0.0 into 0.0.  The SQL oracle uses the same expression.
    """
    return F.round(col(c) * F.lit(1e6) + F.lit(1e-4), 0) / F.lit(1e6) + F.lit(0.0)
