"""Exact quantiles without holding a column's values in one task, or sketched ones in one scan.

Values are counted in fine, ordered bins. Bin totals tell which bin holds each
wanted rank; only the rows of those few bins are then counted value by value.
Both passes aggregate before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.plans.joins import fits_broadcast, join_null_safe, one_row
from tablegauge.plans.ordered import value_bin
from tablegauge.plans.sketches import merged_quantiles, quantile_states
from tablegauge.session import keep


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    group: Sequence[str] = (),
    interpolate: bool = True,
    bin_of: Callable[[Column], Column] = value_bin,
    exact: bool = True,
) -> DataFrame:
    """Rows (group..., column, prob, quantile). Null and NaN are left out.

    `interpolate` gives the linear form (percentile_cont), otherwise the smallest
    value whose cumulative share reaches prob (percentile_disc). With `group` one job
    runs to find the bins. `exact=False` gives a value of the column whose rank is off by
    `sketches.rank_error()` of the rows at most, in one scan and a few kilobytes per group.
    """
    group = list(group)
    by = [*group, "column"]
    if not exact:
        return merged_quantiles(quantile_states(df, columns, group), probs, group)
    # bins are counted from the column's least finite value: their width follows the spread of
    # the values, not their distance from zero (times, long ids)
    value = {c: F.col(f"`{c}`").cast("double") for c in columns}
    finite = lambda v: F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)
    low = one_row(df.agg(*[F.min(finite(v)).alias(f"_low{i}") for i, v in enumerate(value.values())]))
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), v.alias("_value"), F.coalesce(F.col(f"_fit._low{i}"), F.lit(0.0)).alias("_low"))
        for i, (c, v) in enumerate(value.items())
    ])
    long = (
        df.withColumn("_fit", low)
        .select(*group, F.inline(cells))
        .filter(F.col("_value").isNotNull() & ~F.isnan("_value"))
        .withColumn("_bin", bin_of(F.col("_value") - F.col("_low")))
        .drop("_low")
    )
    bins = long.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_rows"))
    along = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = bins.select(
        "*",
        F.sum("_rows").over(along).alias("_upto"),
        F.sum("_rows").over(Window.partitionBy(*by)).alias("_n"),
    )
    wanted = placed.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    if interpolate:
        wanted = wanted.withColumn("_pos", F.col("prob") * (F.col("_n") - 1))
    else:
        wanted = wanted.withColumn(
            "_pos",
            F.greatest(F.ceil(F.round(F.col("prob") * F.col("_n"), 6)) - 1, F.lit(0)).cast("double"),
        )
    wanted = wanted.withColumn("_k0", F.floor("_pos")).withColumn("_k1", F.ceil("_pos"))
    start = F.col("_upto") - F.col("_rows")
    holds = lambda k, lo, hi: (F.col(k) >= lo) & (F.col(k) < hi)
    hits = (
        wanted.filter(holds("_k0", start, F.col("_upto")) | holds("_k1", start, F.col("_upto")))
        .groupBy(*by, "_bin")
        .agg(
            F.max(start).alias("_start"),
            F.collect_list(F.struct("prob", "_pos", "_k0", "_k1")).alias("_want"),
        )
    )
    # without groups there are at most 2 bins per column and probability; with groups
    # the bins are written and counted before they may be broadcast
    if group:
        hits = keep(hits)
    few = not group or fits_broadcast(hits)
    inside = (
        join_null_safe(long, hits.select(*by, "_bin"), [*by, "_bin"], small=few)
        .groupBy(*by, "_bin", "_value")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    climb = Window.partitionBy(*by, "_bin").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    spans = (
        join_null_safe(inside, hits, [*by, "_bin"], small=few)
        .withColumn("_end", F.col("_start") + F.sum("_rows").over(climb))
        .withColumn("_begin", F.col("_end") - F.col("_rows"))
        .select(*by, "_value", "_begin", "_end", F.inline("_want"))
    )
    at = lambda k: F.max(F.when(holds(k, F.col("_begin"), F.col("_end")), F.col("_value")))
    picked = spans.groupBy(*by, "prob").agg(
        at("_k0").alias("_v0"), at("_k1").alias("_v1"), F.max("_pos").alias("_pos")
    )
    part = F.col("_pos") - F.floor("_pos")
    return picked.select(
        *by, "prob",
        F.when(part == 0, F.col("_v0")).otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * part).alias("quantile"),
    )


def quantile_row(df: DataFrame, wanted: dict[str, tuple[str, float]], **kw):
    """Several quantiles as one struct column; `wanted` maps field -> (column, prob)."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    probs = list(dict.fromkeys(p for _, p in wanted.values()))
    table = quantiles(df, columns, probs, **kw)
    return one_row(
        table.agg(
            *[
                F.max(
                    F.when((F.col("column") == c) & (F.col("prob") == float(p)), F.col("quantile"))
                ).alias(field)
                for field, (c, p) in wanted.items()
            ]
        )
    )
