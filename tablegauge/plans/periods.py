"""Calendar periods: truncation, stepping and gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.plans.joins import join_null_safe

GRAINS = ("hour", "day", "week", "month", "quarter", "year")


def period_of(ts: str | Column, grain: str) -> Column:
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}")
    return F.date_trunc(grain, ts)


def shifted(period: str, steps: int, grain: str) -> Column:
    """The period `steps` later (or earlier, if negative)."""
    return F.expr(f"`{period}` + INTERVAL '{steps}' {grain}")


def fill_calendar(
    series: DataFrame, grain: str, dims: Sequence[str] = (), value: str = "value", missing=0.0, common_end: bool = False
) -> DataFrame:
    """Add the periods a series skips between its first and last one, per combination of dims.

    With `common_end` every combination runs to the last period of the whole series, so one
    that falls silent has rows to the end. The number of added rows is set by the calendar,
    not by the data volume.
    """
    dims = list(dims)
    ends = series.groupBy(*dims).agg(F.min("period").alias("_a"), F.max("period").alias("_b"))
    if common_end:
        ends = ends.withColumn("_b", series.agg(F.max("period")).scalar())
    calendar = ends.select(
        *dims, F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL 1 {grain}"))).alias("period")
    )
    joined = join_null_safe(calendar, series, [*dims, "period"], "left")
    return joined.select("period", *dims, F.coalesce(F.col(value), F.lit(missing)).alias(value))
