"""Business KPIs as (period, [dims], value) series. Each is one grouped aggregate unless noted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions.math import ratio, share_of_true
from tablegauge.plans.periods import fill_calendar, period_of, shifted

DAYS_PER_MONTH = 30.4375


def _series(df: DataFrame, ts: str, grain: str, value: Column, dims: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(period_of(ts, grain).alias("period"), *dims).agg(value.alias("value"))


def total_revenue(df: DataFrame, amount: str | Column, ts: str, grain: str = "day", dims: Sequence[str] = ()) -> DataFrame:
    amount = F.col(amount) if isinstance(amount, str) else amount
    return _series(df, ts, grain, F.sum(amount), dims)


def average_order_value(df: DataFrame, amount: str, order: str, ts: str, grain: str = "month", distinct: bool = True) -> DataFrame:
    """Revenue per order; distinct=False divides by rows that name an order instead."""
    orders = F.count_distinct(order) if distinct else F.count(order)
    return _series(df, ts, grain, ratio(F.sum(amount), orders))


def repeat_purchase_rate(df: DataFrame, customer: str, ts: str, grain: str = "month") -> DataFrame:
    """Customers with at least two orders in the period / customers with any."""
    per = df.groupBy(period_of(ts, grain).alias("period"), customer).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy("period").agg(share_of_true(F.col("_n") >= 2).alias("value"))


def status_rate(df: DataFrame, is_hit: Column, ts: str, grain: str = "week") -> DataFrame:
    """Share of rows for which the test holds: cancellations, failures, no-shows."""
    return _series(df, ts, grain, share_of_true(is_hit))


def active_entities(df: DataFrame, entity: str, ts: str, grain: str = "month", exact: bool = True) -> DataFrame:
    count = F.count_distinct(entity) if exact else F.approx_count_distinct(entity)
    return _series(df, ts, grain, count)


def customer_lifetime_value(df: DataFrame, customer: str, amount: str, ts: str) -> DataFrame:
    """Per customer: order value x orders per active month x months between first and last order."""
    months = df.groupBy(customer, period_of(ts, "month").alias("_m")).agg(
        F.sum(amount).alias("_sum"), F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_a"), F.max(ts).alias("_b")
    )
    life = F.datediff(F.max("_b"), F.min("_a")) / DAYS_PER_MONTH
    return months.groupBy(customer).agg(
        ratio(F.sum("_sum"), F.sum("_n")).alias("order_value"),
        ratio(F.sum("_n"), F.count(F.lit(1))).alias("orders_per_month"),
        life.alias("months"),
    ).withColumn("value", F.col("order_value") * F.col("orders_per_month") * F.col("months"))


def monthly_recurring_revenue(df: DataFrame, customer: str, amount: str, ts: str) -> DataFrame:
    """Monthly value and the customers it comes from."""
    per = df.groupBy(period_of(ts, "month").alias("period"), customer).agg(F.sum(amount).alias("_v"))
    return per.groupBy("period").agg(F.sum("_v").alias("value"), F.count(F.lit(1)).alias("customers"))


def _next_value(per: DataFrame, entity: str, grain: str, value: str | None = None) -> DataFrame:
    """Add `_next`: the entity's value (or 1) in the following period, null if it is absent.

    `per` has one row per entity and period, so an entity's window holds at most one
    row per period however many events it has.
    """
    w = Window.partitionBy(entity).orderBy("period")
    value_col = F.col(value) if value else F.lit(1)
    follows = F.lead("period").over(w) == shifted("period", 1, grain)
    return per.withColumn("_next", F.when(follows, F.lead(value_col).over(w)))


def churn_rate(df: DataFrame, entity: str, ts: str, grain: str = "month") -> DataFrame:
    """Entities active in a period and absent in the next / active. The last period is left out."""
    per = df.select(entity, period_of(ts, grain).alias("period")).distinct()
    last = per.agg(F.max("period")).scalar()
    out = _next_value(per, entity, grain).withColumn("_last", last)
    return (
        out.filter(F.col("period") < F.col("_last"))
        .groupBy("period")
        .agg(share_of_true(F.col("_next").isNull()).alias("value"))
    )


def churn_share(df: DataFrame, label: str) -> DataFrame:
    """One row: the mean of a 0/1 churn label."""
    return df.agg(F.avg(F.col(label).cast("double")).alias("value"))


def net_revenue_retention(df: DataFrame, customer: str, amount: str, ts: str, grain: str = "month") -> DataFrame:
    """(start + expansion - contraction - churn) / start over the customers of the period before."""
    per = df.groupBy(customer, period_of(ts, grain).alias("period")).agg(F.sum(amount).alias("_v"))
    moves = _next_value(per, customer, grain, "_v")
    last = per.agg(F.max("period")).scalar()
    diff = F.col("_next") - F.col("_v")
    sums = (
        moves.withColumn("_last", last)
        .filter(F.col("period") < F.col("_last"))
        .groupBy(shifted("period", 1, grain).alias("period"))
        .agg(
            F.sum("_v").alias("start"),
            F.sum(F.when(diff > 0, diff).otherwise(0.0)).alias("expansion"),
            F.sum(F.when(diff < 0, -diff).otherwise(0.0)).alias("contraction"),
            F.sum(F.when(F.col("_next").isNull(), F.col("_v")).otherwise(0.0)).alias("churned"),
        )
    )
    kept = F.col("start") + F.col("expansion") - F.col("contraction") - F.col("churned")
    return sums.withColumn("value", ratio(kept, F.col("start")))


def customer_acquisition_cost(df: DataFrame, customer: str, ts: str, spend: DataFrame, grain: str = "month") -> DataFrame:
    """Spend of the period / customers whose first order lies in it. `spend` is (period, spend)."""
    first = df.groupBy(customer).agg(F.min(ts).alias("_first"))
    new = first.groupBy(period_of("_first", grain).alias("period")).agg(F.count(F.lit(1)).alias("new_customers"))
    joined = spend.join(new, "period", "left").withColumn("new_customers", F.coalesce("new_customers", F.lit(0)))
    return joined.withColumn("value", ratio(F.col("spend"), F.col("new_customers")))


def volume(df: DataFrame, ts: str, grain: str = "day", dims: Sequence[str] = (), counted: str | None = None) -> DataFrame:
    """Rows, or rows with a known `counted`, per period."""
    return _series(df, ts, grain, F.count(counted) if counted else F.count(F.lit(1)), dims)


def average_amount(df: DataFrame, amount: str, ts: str, grain: str = "month", row_id: str | None = None) -> DataFrame:
    rows = F.count(row_id) if row_id else F.count(F.lit(1))
    return _series(df, ts, grain, ratio(F.sum(amount), rows))


def events_per_active_user(df: DataFrame, user: str, ts: str, grain: str = "day") -> DataFrame:
    per = df.groupBy(period_of(ts, grain).alias("period"), user).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy("period").agg(ratio(F.sum("_n"), F.count(user)).alias("value"))


def onboarding_rate(df: DataFrame, user: str, ts: str, step_a: Column, step_b: Column, grain: str = "month") -> DataFrame:
    """Users who reach step B after their first step A / users at step A, by period of the first A."""
    per = df.groupBy(user).agg(
        F.min(F.when(step_a, F.col(ts))).alias("_a"), F.max(F.when(step_b, F.col(ts))).alias("_b")
    )
    started = per.filter(F.col("_a").isNotNull())
    return started.groupBy(period_of("_a", grain).alias("period")).agg(
        F.count(F.lit(1)).alias("started"), share_of_true(F.col("_b") >= F.col("_a")).alias("value")
    )


def readmission_rate(df: DataFrame, entity: str, ts: str, days: int = 30, grain: str = "month") -> DataFrame:
    """Share of visits followed by a later day with a visit of the same entity within `days`."""
    daily = df.groupBy(entity, F.to_date(ts).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(entity).orderBy("_d")
    back = F.datediff(F.lead("_d").over(w), F.col("_d")) <= days
    flagged = daily.withColumn("_back", F.coalesce(back, F.lit(False)))
    return flagged.groupBy(period_of("_d", grain).alias("period")).agg(
        ratio(F.sum(F.when(F.col("_back"), F.col("_n")).otherwise(0)), F.sum("_n")).alias("value")
    )


def average_length_of_stay(df: DataFrame, start: str, end: str, grain: str = "month") -> DataFrame:
    return _series(df, start, grain, F.avg(F.datediff(F.col(end), F.col(start))))


def rate_by_status(df: DataFrame, status: str, ts: str, grain: str = "day") -> DataFrame:
    """(period, status, n, share of the period)."""
    per = df.groupBy(period_of(ts, grain).alias("period"), status).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("period"))
    return per.withColumn("share", ratio(F.col("n"), total))


def trend(df: DataFrame, ts: str, grain: str = "day", amount: str | None = None) -> DataFrame:
    """Count (or sum of an amount) per period, with empty periods as zero."""
    series = volume(df, ts, grain) if amount is None else total_revenue(df, amount, ts, grain)
    return fill_calendar(series.withColumn("value", F.col("value").cast("double")), grain)
