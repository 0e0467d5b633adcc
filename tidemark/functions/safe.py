"""Arithmetic that gives null, not an error, where it isn't defined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: str | Column, b: str | Column, digits: int | None = None) -> Column:
    """a / b, null for a zero divisor, rounded if asked."""
    out = F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)
    return out if digits is None else F.round(out, digits)


def sign(x: str | Column, up=1, down=-1, level=0) -> Column:
    """up, down or level by the sign of x; null counts as level."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x > 0, F.lit(up)).when(x < 0, F.lit(down)).otherwise(F.lit(level))
