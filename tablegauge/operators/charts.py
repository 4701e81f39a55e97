"""The data behind dashboard charts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions.math import percent, ratio
from tablegauge.operators.kpi import monthly_recurring_revenue
from tablegauge.plans.facts import null_count, repeats, wide
from tablegauge.plans.joins import one_row
from tablegauge.plans.periods import period_of


def revenue_by_category(df: DataFrame, category: str, amount: Column) -> DataFrame:
    """(category, revenue, share)."""
    sums = df.groupBy(category).agg(F.sum(amount).alias("revenue"))
    total = df.agg(F.sum(amount)).scalar()
    return sums.withColumn("_t", total).withColumn("share", ratio(F.col("revenue"), F.col("_t"))).drop("_t")


def stage_funnel(df: DataFrame, user: str, stages: dict[str, Column]) -> DataFrame:
    """(place, stage, users, share_of_first) in the order given; users who reached each stage."""
    reached = df.groupBy(user).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(f"_s{i}") for i, c in enumerate(stages.values())])
    row = reached.agg(*[F.count_if(f"_s{i}").alias(f"_s{i}") for i in range(len(stages))])
    structs = [
        F.struct(
            F.lit(i + 1).alias("place"),
            F.lit(name).alias("stage"),
            F.col(f"_s{i}").alias("users"),
            ratio(F.col(f"_s{i}"), F.col("_s0")).alias("share_of_first"),
        )
        for i, name in enumerate(stages)
    ]
    return row.select(F.inline(F.array(*structs)))


def mrr_over_time(df: DataFrame, customer: str, amount: str, ts: str) -> DataFrame:
    """Monthly value with a running sum. The series is one row per month."""
    series = monthly_recurring_revenue(df, customer, amount, ts)
    w = Window.partitionBy().orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("running", F.sum("value").over(w))


def cohort_retention(df: DataFrame, user: str, ts: str, grain: str = "week") -> DataFrame:
    """(cohort, age, users, share): users of each first period still active `age` periods later."""
    days = {"day": 1, "week": 7}
    active = df.select(user, period_of(ts, grain).alias("period")).distinct()
    # one row per user and period, so this window is as long as the calendar
    first = F.min("period").over(Window.partitionBy(user))
    aged = active.withColumn("cohort", first)
    if grain in days:
        age = (F.datediff("period", "cohort") / days[grain]).cast("long")
    else:
        months = (F.year("period") - F.year("cohort")) * 12 + F.month("period") - F.month("cohort")
        age = (months / {"month": 1, "quarter": 3, "year": 12}[grain]).cast("long")
    counts = aged.groupBy("cohort", age.alias("age")).agg(F.count(F.lit(1)).alias("users"))
    start = F.max(F.when(F.col("age") == 0, F.col("users"))).over(Window.partitionBy("cohort"))
    return counts.withColumn("share", ratio(F.col("users"), start))


def activity_heatmap(df: DataFrame, ts: str) -> DataFrame:
    """(weekday, hour, events), weekday 0 = Monday."""
    return df.groupBy(F.weekday(ts).alias("weekday"), F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("events"))


def engagement_vs_value(df: DataFrame, user: str, amount: str) -> DataFrame:
    return df.groupBy(user).agg(F.count(F.lit(1)).alias("events"), F.sum(amount).alias("value"))


def top_users(df: DataFrame, user: str, amount: str, n: int = 10) -> DataFrame:
    return engagement_vs_value(df, user, amount).orderBy(F.col("value").desc(), F.col(user)).limit(n)


def events_by_type_over_time(df: DataFrame, ts: str, kind: str, kinds: Sequence[str], grain: str = "day") -> DataFrame:
    """One row per period with one column per listed type."""
    return df.groupBy(period_of(ts, grain).alias("period")).agg(
        *[F.count_if(F.col(kind) == k).alias(k) for k in kinds]
    )


def table_rates(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, missing_percent, duplicate_percent) per table."""
    rows = []
    for name, df in tables.items():
        facts = wide(df, df.columns, {"nulls": null_count(df)})
        cells = reduce(lambda a, b: a + b, [F.col(f"{i}_nulls") for i in range(len(df.columns))])
        copies = one_row(repeats(df))
        rows.append(
            facts.withColumn("_d", copies).select(
                F.lit(name).alias("table"),
                percent(cells, F.col("n_rows") * len(df.columns)).alias("missing_percent"),
                percent(F.col("_d.duplicate_rows"), F.col("_d.n_rows")).alias("duplicate_percent"),
            )
        )
    return reduce(DataFrame.unionByName, rows)


def drill_down(df: DataFrame, levels: Sequence[str], amount: str) -> DataFrame:
    """Totals at every level of a hierarchy; `level` counts the levels rolled up."""
    return (
        df.rollup(*levels)
        .agg(F.sum(amount).alias("value"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
        .withColumn("level", F.bit_count("_g"))
        .drop("_g")
    )
