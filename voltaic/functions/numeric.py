"""Numbers: the NaN/NULL boundary, guarded arithmetic and the two kinds of rounding.

Inside the engine a missing number is NULL. ``known`` turns NaN and infinities into NULL at ingestion, since Spark orders NaN above all
numbers, counts it and lets it poison averages.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def known(x: Column | str) -> Column:
    """NULL unless finite."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def divide(a: Column | str, b: Column | str) -> Column:
    """NULL where ``b`` is 0 or unknown."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def half_even(x: Column | str) -> Column:
    """Nearest integer, ties to even."""
    return F.rint(col(x))


def half_away(x: Column | str) -> Column:
    """Nearest integer, ties away from zero."""
    return F.round(col(x), 0)


def scale_or_one(sd: Column) -> Column:
    """A spread to divide by: 1 where it is zero or unknown."""
    return F.coalesce(F.when(sd > 0, sd), F.lit(1.0))


def affine(x: Column | str, scale: Column | str | None, offset: Column | str | None) -> Column:
    """scale * x + offset, with 1 and 0 where they are unknown."""
    scale = F.coalesce(col(scale), F.lit(1.0)) if scale is not None else F.lit(1.0)
    offset = F.coalesce(col(offset), F.lit(0.0)) if offset is not None else F.lit(0.0)
    return scale * col(x) + offset
