"""Small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as double; null where the bottom is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def percent(top: Column, bottom: Column, digits: int = 2) -> Column:
    return F.round(ratio(top, bottom) * 100, digits)


def micros(col: Column) -> Column:
    """Microseconds since the epoch of a date or timestamp of either kind."""
    return F.unix_micros(col.cast("timestamp"))


def share_of_true(flag: Column) -> Column:
    """Share of rows where the flag holds; a null flag counts as false."""
    return F.avg(F.when(flag, 1.0).otherwise(0.0))
