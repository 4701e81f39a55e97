"""Alert rules over KPI series.

A series has one row per period (and dimension value), so its windows are as long
as the calendar, not as the data. With `grain` ("day", "month" ...) the periods a series skips
count as 0, up to the last period of the whole series: a dimension value that falls silent
has fallen to 0. Without it the rules go from row to row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions import fixed_values as V
from tablegauge.functions.math import ratio
from tablegauge.plans.periods import fill_calendar, shifted


def _along(dims: Sequence[str]):
    return Window.partitionBy(*dims).orderBy("period")


def _filled(series: DataFrame, dims: Sequence[str], grain: str | None) -> DataFrame:
    if grain is None:
        return series
    zero = F.lit(0).cast(series.schema["value"].dataType)
    return fill_calendar(series, grain, dims, missing=zero, common_end=True).select(*series.columns)


def alert_vs_trailing_avg(
    series: DataFrame, drop: float = 0.15, periods: int = 7, dims: Sequence[str] = (), grain: str | None = None
) -> DataFrame:
    """Periods below (1 - drop) x the mean of the previous ones."""
    series = _filled(series, dims, grain)
    mean = F.avg("value").over(_along(dims).rowsBetween(-periods, -1))
    return series.withColumn("trailing_avg", mean).filter(F.col("value") < (1 - drop) * F.col("trailing_avg"))


def with_change(series: DataFrame, dims: Sequence[str] = (), grain: str | None = None) -> DataFrame:
    """Add previous and change_pct against the previous period of the series."""
    series = _filled(series, dims, grain)
    out = series.withColumn("previous", F.lag("value").over(_along(dims)))
    return out.withColumn("change_pct", ratio(F.col("value") - F.col("previous"), F.col("previous")) * 100)


def alert_period_change(
    series: DataFrame, below_pct: float = -10.0, dims: Sequence[str] = (), grain: str | None = None
) -> DataFrame:
    """Periods whose change is under the limit: -10 for a drop, 0 or 5 for missing growth."""
    return with_change(series, dims, grain).filter(F.col("change_pct") < below_pct)


def alert_level(series: DataFrame, above: float | None = None, below: float | None = None) -> DataFrame:
    """Periods above or below a fixed level."""
    test = F.lit(False)
    if above is not None:
        test = test | (F.col("value") > above)
    if below is not None:
        test = test | (F.col("value") < below)
    return series.filter(test)


def alert_vs_prior_week(series: DataFrame, drop: float = 0.20, grain: str | None = None) -> DataFrame:
    """Days below (1 - drop) x the same day a week before; days without one are not judged."""
    series = _filled(series, [], grain)
    week = series.select(shifted("period", 7, "day").alias("period"), F.col("value").alias("week_before"))
    return series.join(week, "period").filter(F.col("value") < (1 - drop) * F.col("week_before"))


def alert_dim_drop(series: DataFrame, dim: str, drop: float = 0.30, grain: str | None = None) -> DataFrame:
    """Dimension values that fall by more than `drop` against their previous period."""
    return with_change(series, [dim], grain).filter(F.col("change_pct") < -drop * 100)


def alert_kpi_ratio(cost: DataFrame, value: DataFrame, limit: float = 1 / 3) -> DataFrame:
    """Periods where one KPI exceeds `limit` x another."""
    joined = cost.select("period", F.col("value").alias("cost")).join(
        value.select("period", F.col("value").alias("worth")), "period"
    )
    return joined.filter(F.col("cost") > limit * F.col("worth"))


def explain_change(series: DataFrame, metric: str, dims: Sequence[str] = (), grain: str | None = None) -> DataFrame:
    """Per period: change, direction (stable under 1 %), size band and a sentence."""
    out = with_change(series, dims, grain).filter(F.col("change_pct").isNotNull())
    size = F.abs("change_pct")
    severity = (
        F.when(size >= V.CHANGE_SIGNIFICANT, "significant").when(size >= V.CHANGE_MODERATE, "moderate").otherwise("minor")
    )
    direction = (
        F.when(size < 1, "stable").when(F.col("change_pct") > 0, "increasing").otherwise("decreasing")
    )
    title = F.initcap(F.lit(metric.replace("_", " ")))
    out = out.withColumns({"severity": severity, "direction": direction})
    sentence = F.when(
        F.col("direction") == "stable", F.concat(title, F.lit(" held steady"))
    ).otherwise(F.concat_ws(" ", title, F.lit("is"), F.col("direction"), F.concat(F.lit("("), F.col("severity"), F.lit(")"))))
    return out.withColumn("explanation", sentence)


def year_over_year(series: DataFrame) -> DataFrame:
    """Value against the same period a year before."""
    before = series.select(shifted("period", 1, "year").alias("period"), F.col("value").alias("year_before"))
    return series.join(before, "period").withColumn(
        "change_pct", ratio(F.col("value") - F.col("year_before"), F.col("year_before")) * 100
    )


def change_drivers(series: DataFrame, dim: str, top: int = 3, grain: str = "month") -> DataFrame:
    """Per period the dimension values that moved the total most: delta, share of the total move, place."""
    now = series.select("period", dim, F.col("value").alias("_now"))
    was = series.select(shifted("period", 1, grain).alias("period"), dim, F.col("value").alias("_was"))
    span = series.agg(F.struct(F.min("period").alias("a"), F.max("period").alias("b"))).scalar()
    joined = now.join(was, ["period", dim], "full").withColumn("_span", span)
    joined = joined.filter((F.col("period") > F.col("_span.a")) & (F.col("period") <= F.col("_span.b")))
    delta = F.coalesce("_now", F.lit(0.0)) - F.coalesce("_was", F.lit(0.0))
    moved = joined.select("period", dim, delta.alias("delta"))
    totals = moved.groupBy("period").agg(F.sum("delta").alias("_total"))
    place = F.row_number().over(Window.partitionBy("period").orderBy(F.abs("delta").desc(), F.col(dim).asc()))
    # the rank filter stands alone, so it is applied before the shuffle as well
    leaders = moved.withColumn("place", place).filter(F.col("place") <= top)
    return leaders.join(totals, "period").select(
        "period", dim, "delta", ratio(F.col("delta"), F.col("_total")).alias("share"), "place"
    )
