"""Rounding and rates with the database's conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0.0 when ``whole`` is zero."""
    return F.coalesce(part.cast("double") / F.nullif(whole, F.lit(0)), F.lit(0.0))


def int_from_float(x: Column) -> Column:
    """Float to int, halves to even. The inner round removes interpolation noise at halves."""
    return F.bround(F.round(x, 6), 0).cast("int")


def int_from_numeric(x: Column) -> Column:
    """Exact-average to int, halves away from zero."""
    return F.round(x, 0).cast("int")
