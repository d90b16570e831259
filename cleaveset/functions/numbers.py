"""Rounding of doubles as SQL engines do it: the product with a power of ten, halves away from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column | str, digits: int) -> Column:
    """``F.round`` takes the decimal digits of a double instead, which differs where the product is a half."""
    value = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.round(value * 10.0**digits) / 10.0**digits
