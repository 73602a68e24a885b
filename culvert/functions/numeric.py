"""Rounding and exact moments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even at ``digits`` decimals, in plain double arithmetic."""
    if digits == 0:
        return F.rint(value)
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def spread(n: Column, total: Column, squares: Column) -> Column:
    """n * sum(x^2) - (sum x)^2 of integers.

    With (sum x) = q * n + r this is n * (sum(x^2) - q * (sum x + r)) - r^2: the bracket, the sum of squares about q,
    is exact in DECIMAL(38,0) at every size, and no digits cancel after it.
    """
    q = F.floor(total / n).cast("decimal(19,0)")
    t, rest = total.cast("decimal(19,0)"), total - F.floor(total / n) * n
    about = squares.cast("decimal(38,0)") - (q * (t + rest.cast("decimal(18,0)"))).cast("decimal(38,0)")
    return n.cast("double") * about.cast("double") - rest.cast("double") * rest.cast("double")


def pop_std(n: Column, total: Column, squares: Column) -> Column:
    return F.when(n > 1, F.sqrt(spread(n, total, squares)) / n.cast("double")).otherwise(F.lit(0.0))


def pop_var(n: Column, total: Column, squares: Column) -> Column:
    d = n.cast("double")
    return F.when(n > 1, spread(n, total, squares) / (d * d)).otherwise(F.lit(0.0))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom with 0 where the denominator is 0 or missing."""
    d = bottom.cast("double")
    return F.when(d > 0, top.cast("double") / d).otherwise(F.lit(0.0))
