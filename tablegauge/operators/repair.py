"""Repairs named by the checks: DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.math import ratio
from tablegauge.operators.quality import check_constant
from tablegauge.plans.facts import number
from tablegauge.plans.joins import join_fitted, one_row
from tablegauge.plans.quantiles import quantile_row
from tablegauge.sources import schema as S

ONE_HOT_LIMIT = 50


def impute(df: DataFrame, columns: Sequence[str], how: str = "median") -> DataFrame:
    """Fill missing cells with the column's median, mean or mode (ties: smallest value)."""
    names = list(columns)
    if how == "median":
        fit = quantile_row(df, {c: (c, 0.5) for c in names})
        fitted = df.withColumn("_fit", fit)
    elif how == "mean":
        fit = one_row(df.agg(*[F.avg(number(df, c)).alias(c) for c in names]))
        fitted = df.withColumn("_fit", fit)
    elif how == "mode":
        modes = F.struct(*[_mode(df, c).alias(c) for c in names])
        fitted = df.withColumn("_fit", modes)
    else:
        raise ValueError("how must be median, mean or mode")
    out = []
    for c in df.columns:
        if c in names:
            filled = F.coalesce(S.known(df, c), F.col(f"_fit.`{c}`"))
            out.append((filled.cast("double") if how != "mode" else filled).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return fitted.select(*out)


def _mode(df: DataFrame, c: str):
    counts = (
        df.select(S.known(df, c).alias("v")).filter(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v")))).scalar()


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a missing cell in the given columns."""
    return df.dropna(subset=list(columns) if columns else None)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Keep one of each set of identical rows."""
    return df.dropDuplicates()


def drop_constant_columns(df: DataFrame, all_null: bool = True) -> DataFrame:
    """Drop columns with at most one value. Runs one job, since the schema depends on the data."""
    constant = [r["column"] for r in check_constant(df, all_null).select("column").collect()]
    return df.drop(*constant)


def clip_iqr(df: DataFrame, columns: Sequence[str], factor: float = 1.5, exact: bool = True) -> DataFrame:
    """Clip to [Q1 - factor IQR, Q3 + factor IQR]; exact=False takes the quartiles from a sketch."""
    wanted = {}
    for c in columns:
        wanted[f"{c}_q1"] = (c, 0.25)
        wanted[f"{c}_q3"] = (c, 0.75)
    fitted = df.withColumn("_fit", quantile_row(df, wanted, exact=exact))
    out = []
    for c in df.columns:
        if c in columns:
            q1, q3 = F.col(f"_fit.`{c}_q1`"), F.col(f"_fit.`{c}_q3`")
            v, span = number(df, c), (q3 - q1) * factor
            clipped = F.when(v < q1 - span, q1 - span).when(v > q3 + span, q3 + span).otherwise(v)
            out.append(clipped.alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return fitted.select(*out)


def log_transform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """ln(1 + x); null where x <= -1."""
    return df.withColumns({c: F.when(number(df, c) > -1, F.log1p(number(df, c))) for c in columns})


def target_encode(
    df: DataFrame, category: str, target: str, train: DataFrame | None = None, smoothing: float = 0.0
) -> DataFrame:
    """Add `<category>_encoded`: the target mean of the category, fitted on `train` only.

    With smoothing m the mean is pulled to the overall mean with weight m. Unseen
    categories get the overall mean.
    """
    fit = df if train is None else train
    overall = fit.agg(F.avg(F.col(target).cast("double"))).scalar()
    sums = fit.groupBy(category).agg(
        F.sum(F.col(target).cast("double")).alias("_sum"), F.count(target).alias("_n")
    )
    joined = join_fitted(df, sums, [category], "left").withColumn("_all", overall)
    encoded = ratio(F.col("_sum") + F.col("_all") * smoothing, F.col("_n") + F.lit(smoothing))
    return joined.withColumn(f"{category}_encoded", F.coalesce(encoded, F.col("_all"))).drop("_sum", "_n", "_all")


def hash_encode(df: DataFrame, category: str, buckets: int = 64) -> DataFrame:
    """Add `<category>_bucket`, a stable bucket of the category text."""
    digest = F.conv(F.substring(F.md5(F.col(category).cast("string")), 1, 8), 16, 10).cast("long")
    return df.withColumn(f"{category}_bucket", F.pmod(digest, F.lit(buckets)))


def one_hot(df: DataFrame, column: str, values: Sequence | None = None, most: int = ONE_HOT_LIMIT) -> DataFrame:
    """Add one 0/1 column per value. Without `values` one job looks them up.

    `most` is the number of new columns the caller is ready for; more values raise.
    """
    if values is None:
        found = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{column!r} has more than {most} values; allow more or encode it instead")
        values = sorted(r[0] for r in found)
    return df.withColumns(
        {f"{column}_{v}": F.when(F.col(column) == F.lit(v), 1).otherwise(0) for v in values}
    )


def standard_scale(df: DataFrame, columns: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """(x - mean) / sample deviation, fitted on `train`; null when there is no spread."""
    base = df if train is None else train
    fit = one_row(
        base.agg(
            *[F.avg(number(base, c)).alias(f"{c}_m") for c in columns],
            *[F.stddev_samp(number(base, c)).alias(f"{c}_s") for c in columns],
        )
    )
    fitted = df.withColumn("_fit", fit)
    return fitted.withColumns(
        {c: ratio(number(df, c) - F.col(f"_fit.`{c}_m`"), F.col(f"_fit.`{c}_s`")) for c in columns}
    ).drop("_fit")
