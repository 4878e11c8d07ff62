"""NULL is the only missing marker inside plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column | str) -> Column:
    """A number with NaN as NULL."""
    x = F.col(x) if isinstance(x, str) else x
    return F.nullif(x.cast("double"), F.lit(float("nan")))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(x, digits) + F.lit(0.0)
