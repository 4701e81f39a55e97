"""Features for models: per event, per session, per user. `as_of` defaults to the last event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions import fixed_values as V
from tablegauge.functions.math import micros, ratio, share_of_true
from tablegauge.operators.kpi import DAYS_PER_MONTH
from tablegauge.plans.joins import join_null_safe
from tablegauge.plans.ordered import ntile_of, rank_rows, running_totals
from tablegauge.plans.sessions import SECOND, position, sessions, trailing_counts, trailing_frame_rows
from tablegauge.sources import schema as S

DAY = 86_400
BUSINESS_HOURS = (9, 18)


def as_of_time(df: DataFrame, ts: str, as_of: Column | None = None) -> Column:
    """The reference time: given, or the latest time of the table. Never the clock."""
    return as_of if as_of is not None else df.agg(F.max(ts)).scalar()


# --- per event, from its own time ------------------------------------------------


def time_parts(df: DataFrame, ts: str) -> DataFrame:
    """Add hour_of_day, day_of_week (0 = Monday), is_weekend, month_of_year, is_business_hours."""
    hour, day = F.hour(ts), F.weekday(ts)
    low, high = BUSINESS_HOURS
    return df.withColumns(
        {
            "hour_of_day": hour,
            "day_of_week": day,
            "is_weekend": day >= 5,
            "month_of_year": F.month(ts),
            "is_business_hours": (day < 5) & (hour >= low) & (hour < high),
        }
    )


def rolling_event_count(df: DataFrame, user: str, ts: str, days: int = 7, frame: str = "time", key: str | None = None) -> DataFrame:
    """Events of the user in the last `days` days, per event time.

    frame="rows" gives the literal form instead: the count over the current row and
    the `days` rows before it, ordered by (ts, key).
    """
    name = f"rolling_{days}_day_event_count"
    if frame == "rows":
        return trailing_frame_rows(df, [user], [ts, key], days, name)
    return trailing_counts(df, user, ts, {name: (days * DAY, None)})


def row_count_per_id(df: DataFrame, column: str) -> DataFrame:
    """Add row_count_per_id. The counts are aggregated before they are joined back."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("row_count_per_id"))
    return join_null_safe(df, counts, [column])


def null_indicator_flags(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Add a 0/1 column `<c>_is_null` per column."""
    return df.withColumns({f"{c}_is_null": S.missing(df, c).cast("int") for c in (columns or df.columns)})


def row_recency_rank(df: DataFrame, user: str, ts: str, key: str) -> DataFrame:
    """Add recency_rank: 1 for the newest row of the user."""
    # (ts, key) descending = ascending in the negated values
    flipped = df.withColumn("_neg", -F.col(key))
    return (
        position(flipped, [user], [ts, "_neg"], descending=True)
        .withColumnRenamed("position", "recency_rank")
        .drop("_neg")
    )


# --- per user ----------------------------------------------------------------------


def days_since_last_event(df: DataFrame, user: str, ts: str, as_of: Column | None = None, only: Column | None = None) -> DataFrame:
    """Days from the user's last event (that passes `only`) to as_of; null if there is none."""
    last = F.max(F.when(only, F.col(ts)) if only is not None else F.col(ts))
    per = df.groupBy(user).agg(last.alias("_t"))
    return per.withColumn("_as_of", as_of_time(df, ts, as_of)).select(
        user, F.datediff("_as_of", "_t").alias("days")
    )


def days_since_registration(df: DataFrame, user: str, ts: str, as_of: Column | None = None, only: Column | None = None) -> DataFrame:
    """Days from the user's first event (that passes `only`) to as_of."""
    first = F.min(F.when(only, F.col(ts)) if only is not None else F.col(ts))
    per = df.groupBy(user).agg(first.alias("_t"))
    return per.withColumn("_as_of", as_of_time(df, ts, as_of)).select(
        user, F.datediff("_as_of", "_t").alias("days")
    )


def events_per_user(df: DataFrame, user: str, only: Column | None = None) -> DataFrame:
    """Events (or typed events, such as tickets) per user."""
    count = F.count_if(only) if only is not None else F.count(F.lit(1))
    return df.groupBy(user).agg(count.alias("events"))


def distinct_types_per_user(df: DataFrame, user: str, kind: str) -> DataFrame:
    return df.groupBy(user).agg(F.count_distinct(kind).alias("distinct_types"))


def amount_stats(df: DataFrame, user: str, amount: str) -> DataFrame:
    """avg, max, sample std and sum of an amount per user."""
    return df.groupBy(user).agg(
        F.avg(amount).alias("avg_amount"),
        F.max(amount).alias("max_amount"),
        F.stddev_samp(amount).alias("std_amount"),
        F.sum(amount).alias("total_amount"),
    )


def spend_in_last_days(df: DataFrame, user: str, ts: str, amount: str, days: int = 30, as_of: Column | None = None) -> DataFrame:
    """Sum of the amount in the `days` days up to as_of, 0 for users without any."""
    timed = df.withColumn("_as_of", as_of_time(df, ts, as_of))
    recent = F.col(ts) > F.col("_as_of") - F.expr(f"INTERVAL {days} DAYS")
    return timed.groupBy(user).agg(F.sum(F.when(recent, F.col(amount)).otherwise(0.0)).alias("spend"))


def purchase_frequency(df: DataFrame, user: str, ts: str, as_of: Column | None = None) -> DataFrame:
    """Orders per month of account age, with at least one month of age."""
    per = df.groupBy(user).agg(F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_a"))
    per = per.withColumn("_as_of", as_of_time(df, ts, as_of))
    age = F.greatest(F.datediff("_as_of", "_a") / DAYS_PER_MONTH, F.lit(1.0))
    return per.select(user, ratio(F.col("_n"), age).alias("purchases_per_month"))


def flag_rate(df: DataFrame, user: str, flag: Column, name: str = "rate") -> DataFrame:
    """Share of the user's rows with the flag: refunds, failed payments, discounted orders."""
    return df.groupBy(user).agg(share_of_true(flag).alias(name))


def count_ratio(df: DataFrame, user: str, top: Column, bottom: Column, name: str = "rate") -> DataFrame:
    """Rows passing `top` / rows passing `bottom`, such as clicks / views."""
    return df.groupBy(user).agg(ratio(F.count_if(top), F.count_if(bottom)).alias(name))


def trailing_ratio(df: DataFrame, user: str, ts: str, flag: Column, seconds: int = DAY) -> DataFrame:
    """Share of flagged events among the user's events of the last `seconds`, per event time."""
    counts = trailing_counts(df, user, ts, {"n_all": (seconds, None), "n_flag": (seconds, flag)})
    return counts.withColumn("ratio", ratio(F.col("n_flag"), F.col("n_all")))


def session_count(df: DataFrame, user: str, ts: str, days: int = 30, gap_seconds: int = 1800, as_of: Column | None = None) -> DataFrame:
    """Sessions that start in the `days` days up to as_of."""
    found = sessions(df, user, ts, gap_seconds).withColumn("_as_of", micros(as_of_time(df, ts, as_of)))
    recent = F.col("start_us") > F.col("_as_of") - days * DAY * SECOND
    return found.groupBy(user).agg(F.count_if(recent).alias("sessions"))


def avg_session_duration(df: DataFrame, user: str, ts: str, gap_seconds: int = 1800) -> DataFrame:
    """Mean session length in seconds."""
    found = sessions(df, user, ts, gap_seconds)
    return found.groupBy(user).agg(((F.avg(F.col("end_us") - F.col("start_us"))) / SECOND).alias("seconds"))


def distinct_types_per_session(df: DataFrame, user: str, ts: str, kind: str, kinds: Sequence[str], gap_seconds: int = 1800) -> DataFrame:
    """Mean number of distinct event types per session; `kinds` lists the types."""
    found = sessions(df, user, ts, gap_seconds, {f"_k{i}": F.col(kind) == k for i, k in enumerate(kinds)})
    present = sum([(F.col(f"_k{i}") > 0).cast("int") for i in range(len(kinds))], F.lit(0))
    return found.groupBy(user).agg(F.avg(present).alias("types_per_session"))


def bounce_rate(df: DataFrame, user: str, ts: str, gap_seconds: int = 1800) -> DataFrame:
    """Sessions of one event / sessions."""
    return sessions(df, user, ts, gap_seconds).groupBy(user).agg(
        share_of_true(F.col("n_events") == 1).alias("bounce_rate")
    )


def cart_abandonment_rate(df: DataFrame, user: str, ts: str, cart: Column, bought: Column, gap_seconds: int = 1800) -> DataFrame:
    """Sessions with a cart event and no purchase / sessions with a cart event."""
    found = sessions(df, user, ts, gap_seconds, {"_cart": cart, "_buy": bought})
    carts = F.col("_cart") > 0
    return found.groupBy(user).agg(
        ratio(F.count_if(carts & (F.col("_buy") == 0)), F.count_if(carts)).alias("abandonment_rate")
    )


def views_before_purchase(df: DataFrame, user: str, ts: str, key: str, view: Column, bought: Column, chunk_seconds: int = 600) -> DataFrame:
    """(user, purchase_no, views): views since the purchase before, for every purchase."""
    staged = df.select(
        user, key, micros(F.col(ts)).alias("_t"),
        F.coalesce(bought, F.lit(False)).cast("long").alias("_buy"),
        F.coalesce(view, F.lit(False)).cast("long").alias("_view"),
    )
    chunk = F.floor(F.col("_t") / (chunk_seconds * SECOND))
    placed = running_totals(staged, [user], [chunk], [F.col("_t"), F.col(key)], ["_buy"])
    # an event belongs to the purchase that ends its stretch
    stretch = F.col("_buy_upto") - F.col("_buy") + 1
    return (
        placed.groupBy(user, stretch.alias("purchase_no"))
        .agg(F.sum("_view").alias("views"), F.max("_buy").alias("_done"))
        .filter(F.col("_done") == 1)
        .drop("_done")
    )


def avg_items_per_order(df: DataFrame, user: str, order: str, quantity: str) -> DataFrame:
    per = df.groupBy(user, order).agg(F.sum(quantity).alias("_q"))
    return per.groupBy(user).agg(F.avg("_q").alias("items_per_order"))


def days_between_orders(df: DataFrame, user: str, ts: str) -> DataFrame:
    """Mean gap in days: the gaps add up to last - first, so no ordering is needed."""
    per = df.groupBy(user).agg(F.datediff(F.max(ts), F.min(ts)).alias("_span"), F.count(F.lit(1)).alias("_n"))
    return per.select(user, ratio(F.col("_span"), F.col("_n") - 1).alias("days_between_orders"))


def preferred_value(df: DataFrame, user: str, column: str) -> DataFrame:
    """The user's most frequent value, ties to the smallest."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(user, column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(user).agg(
        F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias("preferred")
    )


def transaction_velocity(df: DataFrame, user: str, ts: str) -> DataFrame:
    """Transactions per hour over the user's active span; null for a span of zero."""
    t = micros(F.col(ts))
    per = df.groupBy(user).agg(F.count(F.lit(1)).alias("_n"), ((F.max(t) - F.min(t)) / (3600 * SECOND)).alias("_h"))
    return per.select(user, ratio(F.col("_n"), F.col("_h")).alias("per_hour"))


def unusual_category(df: DataFrame, user: str, category: str, limit: float = 0.1) -> DataFrame:
    """(user, category, share, unusual): categories that make up less than `limit` of the user's rows."""
    counts = df.groupBy(user, category).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(user).agg(F.sum("_n").alias("_all"))
    share = ratio(F.col("_n"), F.col("_all"))
    return join_null_safe(counts, totals, [user]).select(
        user, category, share.alias("share"), (share < limit).alias("unusual")
    )


def cross_border(lines: DataFrame, orders: DataFrame, customers: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Order lines with cross_border: the customer's nation differs from the supplier's."""
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .withColumn("cross_border", F.col("c_nationkey") != F.col("s_nationkey"))
    )


def amount_trend(df: DataFrame, user: str, ts: str, amount: str) -> DataFrame:
    """Slope of the amount per day, by least squares."""
    # days since a fixed date near the data keep the sums small
    day = (micros(F.col(ts)) - F.lit(946_684_800 * SECOND)) / (DAY * SECOND)
    return df.groupBy(user).agg(F.regr_slope(F.col(amount), day).alias("trend_per_day"))


def drop_id_columns(df: DataFrame) -> DataFrame:
    """Drop columns whose name marks an identifier. Uses names only."""
    words = dict(V.MEANING_RULES)["identifier"]
    return df.drop(*[c for c in df.columns if any(w in c.lower() for w in words)])


def rfm_segments(df: DataFrame, customer: str, ts: str, amount: str, as_of: Column | None = None, tiles: int = 5) -> DataFrame:
    """Recency, frequency and money quintiles per customer (5 = best) and a three-digit code.

    `customer` is an integer key; it breaks ties.
    """
    per = df.groupBy(customer).agg(
        F.max(ts).alias("_last"), F.count(F.lit(1)).alias("frequency"), F.round(F.sum(amount), 2).alias("monetary")
    )
    per = per.withColumn("_as_of", as_of_time(df, ts, as_of))
    base = per.select(
        customer, F.datediff("_as_of", "_last").cast("long").alias("recency"), "frequency", "monetary"
    )
    n = base.agg(F.count(F.lit(1))).scalar()
    names = ("recency", "frequency", "monetary")
    long = base.select(customer, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        [customer], list(names), "_measure", "_value"
    )
    tiled = rank_rows(long, "_value", customer, ["_measure"]).withColumn("_n", n)
    tile = ntile_of(F.col("row_rank"), F.col("_n"), tiles)
    scores = tiled.withColumn(
        "_tile", F.when(F.col("_measure") == "recency", tiles + 1 - tile).otherwise(tile)
    )
    of = lambda m, c: F.max(F.when(F.col("_measure") == m, F.col(c)))
    scored = scores.groupBy(customer).agg(
        of("recency", "_value").cast("long").alias("recency"),
        of("frequency", "_value").cast("long").alias("frequency"),
        of("monetary", "_value").alias("monetary"),
        *[of(m, "_tile").alias(f"{m[0]}_score") for m in names],
    )
    code = F.concat(*[F.col(f"{c}_score").cast("string") for c in "rfm"])
    return scored.withColumn("segment", code)


def user_feature_table(
    df: DataFrame,
    user: str,
    ts: str,
    kind: str,
    amount: str,
    kinds: dict[str, str],
    as_of: Column | None = None,
    gap_seconds: int = 1800,
) -> DataFrame:
    """The per-user features as one wide table: one grouped aggregate joined with one session pass.

    `kinds` names the event types that stand for view, click, purchase, error, signup.
    """
    at = lambda role: F.col(kind) == kinds[role]
    timed = df.withColumn("_as_of", as_of_time(df, ts, as_of))
    recent = F.col(ts) > F.col("_as_of") - F.expr("INTERVAL 30 DAYS")
    buys = F.when(at("purchase"), F.col(amount))
    wide = timed.groupBy(user).agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_distinct(kind).alias("distinct_event_types"),
        F.datediff(F.max("_as_of"), F.max(ts)).alias("days_since_last_event"),
        F.datediff(F.max("_as_of"), F.min(ts)).alias("days_since_registration"),
        F.datediff(F.max("_as_of"), F.max(F.when(at("purchase"), F.col(ts)))).alias("days_since_last_purchase"),
        F.count_if(at("error")).alias("errors"),
        share_of_true(at("error")).alias("failed_ratio"),
        ratio(F.count_if(at("click")), F.count_if(at("view"))).alias("click_through_rate"),
        F.avg(buys).alias("avg_amount"),
        F.max(buys).alias("max_amount"),
        F.stddev_samp(buys).alias("std_amount"),
        F.sum(buys).alias("lifetime_revenue"),
        F.sum(F.when(recent & at("purchase"), F.col(amount)).otherwise(0.0)).alias("spend_last_30_days"),
    )
    found = sessions(df, user, ts, gap_seconds, {"_click": at("click"), "_buy": at("purchase")})
    per_session = found.groupBy(user).agg(
        F.count(F.lit(1)).alias("sessions"),
        (F.avg(F.col("end_us") - F.col("start_us")) / SECOND).alias("avg_session_seconds"),
        share_of_true(F.col("n_events") == 1).alias("bounce_rate"),
        ratio(
            F.count_if((F.col("_click") > 0) & (F.col("_buy") == 0)), F.count_if(F.col("_click") > 0)
        ).alias("abandonment_rate"),
    )
    return wide.join(per_session, user, "left")
