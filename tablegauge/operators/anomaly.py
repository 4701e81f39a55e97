"""Z-score and IQR anomalies of one numeric column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions import fixed_values as V
from tablegauge.functions.math import ratio
from tablegauge.plans.facts import number
from tablegauge.plans.joins import join_fitted, join_null_safe, one_row
from tablegauge.plans.quantiles import quantile_row, quantiles
from tablegauge.sources import schema as S

METHODS = ("zscore", "iqr", "both")


def _check(df: DataFrame, column: str, method: str) -> None:
    S.require_numeric(df, column)
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")


def _flag_columns(v: Column, fit, threshold: float, factor: float) -> tuple[Column, Column, Column]:
    """z (population form), z flag and IQR flag."""
    z = (v - fit("mean")) / F.when(fit("sd_pop") > 0, fit("sd_pop"))
    span = (fit("q3") - fit("q1")) * factor
    return z, F.abs(z) > threshold, (v < fit("q1") - span) | (v > fit("q3") + span)


def _spread(df: DataFrame, column: str) -> list[Column]:
    v = number(df, column)
    return [
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("sd_pop"),
        F.stddev_samp(v).alias("sd_samp"),
    ]


def flagged(
    df: DataFrame, column: str, method: str = "both", threshold: float = V.Z_LIMIT, factor: float = 1.5, exact: bool = True,
) -> DataFrame:
    """Every row with `z`, `by_zscore`, `by_iqr`. Flags of methods not asked for are false.

    exact=False takes the quartiles from a sketch.
    """
    _check(df, column, method)
    out = df.withColumn("_fit", one_row(df.agg(*_spread(df, column))))
    if method != "zscore":
        out = out.withColumn("_q", quantile_row(df, {"q1": (column, 0.25), "q3": (column, 0.75)}, exact=exact))
    fit = lambda f: F.col(f"_q.{f}") if f in ("q1", "q3") else F.col(f"_fit.{f}")
    v = number(df, column)
    off = F.lit(False)
    if method == "zscore":
        z = (v - fit("mean")) / F.when(fit("sd_pop") > 0, fit("sd_pop"))
        by_z, by_iqr = F.abs(z) > threshold, off
    else:
        z, by_z, by_iqr = _flag_columns(v, fit, threshold, factor)
        by_z = off if method == "iqr" else by_z
    return out.select(
        *df.columns,
        z.alias("z"),
        F.coalesce(by_z, off).alias("by_zscore"),
        F.coalesce(by_iqr, off).alias("by_iqr"),
    )


def anomalies(df: DataFrame, column: str, key: Sequence[str], method: str = "zscore", **limits) -> DataFrame:
    """The flagged rows: key columns, value, z and the method flags."""
    return (
        flagged(df, column, method, **limits)
        .filter(F.col("by_zscore") | F.col("by_iqr"))
        .select(*key, F.col(column).alias("value"), "z", "by_zscore", "by_iqr")
    )


def anomaly_thresholds(df: DataFrame, column: str, method: str = "both", exact: bool = True) -> DataFrame:
    """Per method: anomalies, lower, upper, q1, q3, iqr.

    The z flags use the population deviation while the reported z limits use the
    sample deviation, so a flagged value may lie inside the reported limits.
    """
    _check(df, column, method)
    counts = flagged(df, column, method, exact=exact).agg(
        F.count_if("by_zscore").alias("nz"), F.count_if("by_iqr").alias("ni")
    )
    row = counts.withColumn("f", one_row(df.agg(*_spread(df, column))))
    if method == "zscore":
        row = row.withColumn("q", F.struct(F.lit(None).cast("double").alias("q1"), F.lit(None).cast("double").alias("q3")))
    else:
        row = row.withColumn("q", quantile_row(df, {"q1": (column, 0.25), "q3": (column, 0.75)}, exact=exact))
    none = F.lit(None).cast("double")
    span = F.col("q.q3") - F.col("q.q1")
    parts = []
    if method != "iqr":
        parts.append(
            F.struct(
                F.lit("zscore").alias("method"),
                F.col("nz").alias("anomalies"),
                (F.col("f.mean") - 3 * F.col("f.sd_samp")).alias("lower"),
                (F.col("f.mean") + 3 * F.col("f.sd_samp")).alias("upper"),
                none.alias("q1"),
                none.alias("q3"),
                none.alias("iqr"),
            )
        )
    if method != "zscore":
        parts.append(
            F.struct(
                F.lit("iqr").alias("method"),
                F.col("ni").alias("anomalies"),
                (F.col("q.q1") - 1.5 * span).alias("lower"),
                (F.col("q.q3") + 1.5 * span).alias("upper"),
                F.col("q.q1").alias("q1"),
                F.col("q.q3").alias("q3"),
                span.alias("iqr"),
            )
        )
    return row.filter(F.col("f.n") > 0).select(F.inline(F.array(*parts)))


def anomaly_summary(df: DataFrame, column: str, method: str = "both") -> DataFrame:
    """One row: total, percent of the known values, rate band. No row for an all-null column."""
    found = flagged(df, column, method).agg(
        F.count(number(df, column)).alias("n"),
        F.count_if(F.col("by_zscore") | F.col("by_iqr")).alias("total"),
    )
    rated = found.filter(F.col("n") > 0).withColumn("percent", F.round(ratio(F.col("total"), F.col("n")) * 100, 2))
    band = (
        F.when(F.col("total") == 0, "none")
        .when(F.col("percent") < V.RATE_LOW, "low")
        .when(F.col("percent") < V.RATE_MODERATE, "moderate")
        .otherwise("high")
    )
    return rated.select("total", "percent", band.alias("rate"))


def anomaly_sample(df: DataFrame, column: str, key: Sequence[str], method: str = "both", n: int = 20) -> DataFrame:
    """The first n flagged rows by key."""
    return anomalies(df, column, key, method).orderBy(*key).limit(n)


def anomalies_grouped(df: DataFrame, column: str, group: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Both methods with limits fitted per group.

    The group statistics are aggregated first and joined back, so a large group stays
    spread over the tasks of the scan. Runs the jobs that fit them.
    """
    S.require_numeric(df, column)
    group = list(group)
    stats = df.groupBy(*group).agg(*_spread(df, column))
    q = quantiles(df, [column], [0.25, 0.75], group)
    bounds = q.groupBy(*group).agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("quantile"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.75, F.col("quantile"))).alias("q3"),
    )
    fits = join_null_safe(stats, bounds, group)
    names = ("n", "mean", "sd_pop", "sd_samp", "q1", "q3")
    fits = fits.select(*group, F.struct(*names).alias("_fit"))
    joined = join_fitted(df, fits, group)
    v = number(df, column)
    z, by_z, by_iqr = _flag_columns(v, lambda f: F.col(f"_fit.{f}"), V.Z_LIMIT, 1.5)
    off = F.lit(False)
    return (
        joined.withColumns({"_z": z, "_bz": F.coalesce(by_z, off), "_bi": F.coalesce(by_iqr, off)})
        .filter(F.col("_bz") | F.col("_bi"))
        .select(
            *group, *key, F.col(column).alias("value"), F.col("_z").alias("z"),
            F.col("_bz").alias("by_zscore"), F.col("_bi").alias("by_iqr"),
        )
    )
