"""Features (I1-I45)."""

from pyspark.sql import functions as F

from tablegauge.operators import features as X
from tablegauge.workload.registry import plain, query

kind = lambda name: F.col("event_type") == name
GAP = 4 * 3600


def sess(gap_minutes: int) -> str:
    return f"""WITH e AS (SELECT *, CASE WHEN lag(ts) OVER u IS NULL OR ts - lag(ts) OVER u > INTERVAL {gap_minutes} MINUTE THEN 1 ELSE 0 END AS fresh
 FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
x AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sno FROM e),
s AS (SELECT user_id, sno, min(ts) AS a, max(ts) AS b, count(*) AS n, count(DISTINCT event_type) AS kinds,
 count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS buys FROM x GROUP BY 1, 2)
"""


PARTS = {
    "i1_hour_of_day": ("hour_of_day", "CAST(hour(ts) AS BIGINT)"),
    "i2_day_of_week": ("day_of_week", "CAST(isodow(ts) - 1 AS BIGINT)"),
    "i3_is_weekend": ("is_weekend", "isodow(ts) >= 6"),
    "i4_month_of_year": ("month_of_year", "CAST(month(ts) AS BIGINT)"),
    "i5_is_business_hours": ("is_business_hours", "isodow(ts) <= 5 AND hour(ts) >= 9 AND hour(ts) < 18"),
}


def _part(name, column, sql):
    @query(name, f"SELECT event_id, {sql} AS {column} FROM events")
    def _(t):
        return plain(X.time_parts(t.events, "ts").select("event_id", column))


for _name, (_column, _sql) in PARTS.items():
    _part(_name, _column, _sql)

LAST = "(SELECT max(ts) FROM events)"


@query("i6_days_since_last_event", f"SELECT user_id, date_diff('day', max(ts), {LAST}) AS days FROM events GROUP BY 1")
def _(t):
    return plain(X.days_since_last_event(t.events, "user_id", "ts"))


def frame(interval: str, what: str = "count(*)") -> str:
    return f"{what} OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {interval} PRECEDING AND CURRENT ROW)"


def trailing(columns: str) -> str:
    return f"SELECT DISTINCT user_id, epoch_us(ts) AS event_us, {columns} FROM events"


@query("i7_rolling_7_day_event_count", trailing(frame("7 DAY") + " AS rolling_7_day_event_count"))
def _(t):
    return X.rolling_event_count(t.events, "user_id", "ts", 7)


@query(
    "i7_rolling_7_rows_event_count",
    """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 7 PRECEDING) AS rolling_7_day_event_count FROM events""",
)
def _(t):
    return X.rolling_event_count(t.events, "user_id", "ts", 7, "rows", "event_id").select(
        "event_id", "rolling_7_day_event_count"
    )


@query("i8_rolling_30_day_event_count", trailing(frame("30 DAY") + " AS rolling_30_day_event_count"))
def _(t):
    return X.rolling_event_count(t.events, "user_id", "ts", 30)


@query("i9_total_events_per_user", "SELECT user_id, count(*) AS events FROM events GROUP BY 1")
def _(t):
    return X.events_per_user(t.events, "user_id")


@query(
    "i10_events_last_hour_and_day",
    trailing(frame("1 HOUR") + " AS events_last_hour, " + frame("24 HOUR") + " AS events_last_24h"),
)
def _(t):
    return X.trailing_counts(t.events, "user_id", "ts", {"events_last_hour": (3600, None), "events_last_24h": (86400, None)})


@query("i11_distinct_event_types_used", "SELECT user_id, count(DISTINCT event_type) AS distinct_types FROM events GROUP BY 1")
def _(t):
    return X.distinct_types_per_user(t.events, "user_id", "event_type")


@query(
    "i12_session_count_last_30_days",
    sess(30) + f"SELECT user_id, count(*) FILTER (WHERE a > {LAST} - INTERVAL 10 DAY) AS sessions FROM s GROUP BY 1",
)
def _(t):
    return X.session_count(t.events, "user_id", "ts", days=10)


@query(
    "i13_days_since_registration",
    f"SELECT user_id, date_diff('day', min(ts) FILTER (WHERE event_type = 'signup'), {LAST}) AS days FROM events GROUP BY 1",
)
def _(t):
    return plain(X.days_since_registration(t.events, "user_id", "ts", only=kind("signup")))


@query(
    "i14_days_since_last_login",
    f"SELECT user_id, date_diff('day', max(ts) FILTER (WHERE event_type = 'view'), {LAST}) AS days FROM events GROUP BY 1",
)
def _(t):
    return plain(X.days_since_last_event(t.events, "user_id", "ts", only=kind("view")))


@query(
    "i15_avg_session_duration",
    sess(240) + "SELECT user_id, round(avg(epoch_us(b) - epoch_us(a)) / 1000000, 4) AS seconds FROM s GROUP BY 1",
)
def _(t):
    return plain(X.avg_session_duration(t.events, "user_id", "ts", GAP))


@query("i16_support_ticket_count", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS events FROM events GROUP BY 1")
def _(t):
    return X.events_per_user(t.events, "user_id", kind("error"))


@query(
    "i17_transaction_amount_stats",
    """SELECT o_custkey, round(avg(o_totalprice), 6) AS avg_amount, max(o_totalprice) AS max_amount, round(stddev_samp(o_totalprice), 6) AS std_amount,
 round(sum(o_totalprice), 6) AS total_amount FROM orders GROUP BY 1""",
)
def _(t):
    return plain(X.amount_stats(t.orders, "o_custkey", "o_totalprice"), 6)


@query(
    "i18_total_spend_last_30_days",
    "SELECT o_custkey, round(sum(CASE WHEN o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY THEN o_totalprice ELSE 0 END), 4) AS spend FROM orders GROUP BY 1",
)
def _(t):
    return plain(X.spend_in_last_days(t.orders, "o_custkey", "o_orderdate", "o_totalprice"))


@query(
    "i19_days_since_last_purchase",
    "SELECT o_custkey, date_diff('day', max(o_orderdate), (SELECT max(o_orderdate) FROM orders)) AS days FROM orders GROUP BY 1",
)
def _(t):
    return plain(X.days_since_last_event(t.orders, "o_custkey", "o_orderdate"))


@query(
    "i20_purchase_frequency",
    """SELECT o_custkey, round(n / greatest(CAST(age AS DOUBLE) / CAST(30.4375 AS DOUBLE), 1.0), 4) AS purchases_per_month FROM
(SELECT o_custkey, count(*) AS n, date_diff('day', min(o_orderdate), (SELECT max(o_orderdate) FROM orders)) AS age FROM orders GROUP BY 1)""",
)
def _(t):
    return plain(X.purchase_frequency(t.orders, "o_custkey", "o_orderdate"))


@query("i21_lifetime_revenue", "SELECT o_custkey, round(sum(o_totalprice), 4) AS lifetime_revenue FROM orders GROUP BY 1")
def _(t):
    out = X.amount_stats(t.orders, "o_custkey", "o_totalprice")
    return plain(out.select("o_custkey", F.col("total_amount").alias("lifetime_revenue")))


@query("i22_refund_rate", "SELECT l_suppkey, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS refund_rate FROM lineitem GROUP BY 1")
def _(t):
    return plain(X.flag_rate(t.lineitem, "l_suppkey", F.col("l_returnflag") == "R", "refund_rate"), 6)


@query(
    "i23_failed_event_ratio_24h",
    f"""SELECT user_id, event_us, n_all, n_flag, round(n_flag * 1.0 / n_all, 4) AS ratio FROM (
{trailing(frame("24 HOUR") + " AS n_all, " + frame("24 HOUR", "count(*) FILTER (WHERE event_type = 'error')") + " AS n_flag")})""",
)
def _(t):
    return plain(X.trailing_ratio(t.events, "user_id", "ts", kind("error")))


@query("i24_error_count_7_days", trailing(frame("7 DAY", "count(*) FILTER (WHERE event_type = 'error')") + " AS errors_7d"))
def _(t):
    return X.trailing_counts(t.events, "user_id", "ts", {"errors_7d": (7 * X.DAY, kind("error"))})


@query("i25_login_attempts_last_hour", trailing(frame("1 HOUR", "count(*) FILTER (WHERE event_type = 'signup')") + " AS logins_1h"))
def _(t):
    return X.trailing_counts(t.events, "user_id", "ts", {"logins_1h": (3600, kind("signup"))})


@query(
    "i26_click_through_rate",
    "SELECT user_id, round(count(*) FILTER (WHERE event_type = 'click') * 1.0 / nullif(count(*) FILTER (WHERE event_type = 'view'), 0), 4) AS click_through_rate FROM events GROUP BY 1",
)
def _(t):
    return plain(X.count_ratio(t.events, "user_id", kind("click"), kind("view"), "click_through_rate"))


TYPES = ("view", "signup", "error", "click", "purchase")


@query("i27_distinct_event_types_per_session", sess(240) + "SELECT user_id, round(avg(kinds), 4) AS types_per_session FROM s GROUP BY 1")
def _(t):
    return plain(X.distinct_types_per_session(t.events, "user_id", "ts", "event_type", TYPES, GAP))


@query(
    "i28_page_views_before_purchase",
    """WITH p AS (SELECT user_id, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)
 - CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END + 1 AS no FROM events)
SELECT user_id, CAST(no AS BIGINT) AS purchase_no, count(*) FILTER (WHERE event_type = 'view') AS views FROM p GROUP BY 1, 2 HAVING count(*) FILTER (WHERE event_type = 'purchase') = 1""",
)
def _(t):
    return X.views_before_purchase(t.events, "user_id", "ts", "event_id", kind("view"), kind("purchase"))


@query("i29_bounce_rate_per_session", sess(240) + "SELECT user_id, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 4) AS bounce_rate FROM s GROUP BY 1")
def _(t):
    return plain(X.bounce_rate(t.events, "user_id", "ts", GAP))


@query(
    "i30_cart_abandonment_rate",
    sess(240)
    + "SELECT user_id, round(count(*) FILTER (WHERE clicks > 0 AND buys = 0) * 1.0 / nullif(count(*) FILTER (WHERE clicks > 0), 0), 4) AS abandonment_rate FROM s GROUP BY 1",
)
def _(t):
    return plain(X.cart_abandonment_rate(t.events, "user_id", "ts", kind("click"), kind("purchase"), GAP))


@query(
    "i31_avg_items_per_order",
    """SELECT o_custkey, round(avg(q), 4) AS items_per_order FROM (SELECT o_custkey, o_orderkey, sum(l_quantity) AS q
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1""",
)
def _(t):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return plain(X.avg_items_per_order(lines, "o_custkey", "o_orderkey", "l_quantity"))


@query(
    "i32_days_between_orders",
    """SELECT o_custkey, round(avg(gap), 4) AS days_between_orders FROM (SELECT o_custkey,
 date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS gap FROM orders) GROUP BY 1""",
)
def _(t):
    return plain(X.days_between_orders(t.orders, "o_custkey", "o_orderdate"))


@query(
    "i33_preferred_value",
    """SELECT user_id, event_type AS preferred FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r
FROM events GROUP BY 1, 2) WHERE r = 1""",
)
def _(t):
    return X.preferred_value(t.events, "user_id", "event_type")


@query(
    "i34_discount_sensitivity",
    """SELECT o_custkey, round(avg(CASE WHEN l_discount > 0 THEN 1.0 ELSE 0.0 END), 4) AS discounted FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(t):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return plain(X.flag_rate(lines, "o_custkey", F.col("l_discount") > 0, "discounted"))


@query("i35_failed_payment_ratio", "SELECT user_id, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS failed_ratio FROM events GROUP BY 1")
def _(t):
    return plain(X.flag_rate(t.events, "user_id", kind("error"), "failed_ratio"), 6)


@query(
    "i36_transaction_velocity",
    "SELECT user_id, round(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(3600000000 AS DOUBLE), 0), 4) AS per_hour FROM events GROUP BY 1",
)
def _(t):
    return plain(X.transaction_velocity(t.events, "user_id", "ts"))


@query(
    "i37_unusual_category_flag",
    """SELECT user_id, event_type, round(n * 1.0 / a, 4) AS share, n * 1.0 / a < 0.18 AS unusual FROM (
SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS a FROM events GROUP BY 1, 2)""",
)
def _(t):
    return plain(X.unusual_category(t.events, "user_id", "event_type", 0.18))


@query(
    "i38_cross_border_flag",
    """SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE c_nationkey <> s_nationkey) AS crossing FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""",
)
def _(t):
    out = X.cross_border(t.lineitem, t.orders, t.customer, t.supplier)
    return out.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("cross_border").alias("crossing")
    )


@query(
    "i39_account_balance_trend",
    "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderdate) > 1 THEN round(regr_slope(o_totalprice, epoch_us(o_orderdate) / CAST(86400000000 AS DOUBLE) - 10957), 4) END AS trend_per_day FROM orders GROUP BY 1",
)
def _(t):
    # one order has no slope
    return plain(X.amount_trend(t.orders, "o_custkey", "o_orderdate", "o_totalprice"))


@query("i40_row_count_per_id", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS row_count_per_id FROM orders")
def _(t):
    return X.row_count_per_id(t.orders, "o_custkey").select("o_orderkey", "row_count_per_id")


@query(
    "i41_null_indicator_flags",
    "SELECT event_id, CAST(value < 5 AS BIGINT) AS value_is_null, CAST(event_type = 'error' AS BIGINT) AS event_type_is_null FROM events",
)
def _(t):
    from tablegauge.workload.samples import holey_events

    out = X.null_indicator_flags(holey_events(t.events), ["value", "event_type"])
    return plain(out.select("event_id", "value_is_null", "event_type_is_null"))


@query(
    "i42_row_recency_rank",
    "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency_rank FROM events",
)
def _(t):
    return X.row_recency_rank(t.events, "user_id", "ts", "event_id").select("event_id", "recency_rank")


@query(
    "i43_user_feature_table",
    sess(30)
    + f""", w AS (SELECT user_id, count(*) AS total_events, count(DISTINCT event_type) AS distinct_event_types,
 date_diff('day', max(ts), {LAST}) AS days_since_last_event, date_diff('day', min(ts), {LAST}) AS days_since_registration,
 date_diff('day', max(ts) FILTER (WHERE event_type = 'purchase'), {LAST}) AS days_since_last_purchase,
 count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS failed_ratio,
 round(count(*) FILTER (WHERE event_type = 'click') * 1.0 / nullif(count(*) FILTER (WHERE event_type = 'view'), 0), 6) AS click_through_rate,
 round(avg(value) FILTER (WHERE event_type = 'purchase'), 6) AS avg_amount, max(value) FILTER (WHERE event_type = 'purchase') AS max_amount,
 round(stddev_samp(value) FILTER (WHERE event_type = 'purchase'), 6) AS std_amount, round(sum(value) FILTER (WHERE event_type = 'purchase'), 6) AS lifetime_revenue,
 round(sum(CASE WHEN event_type = 'purchase' AND ts > {LAST} - INTERVAL 30 DAY THEN value ELSE 0 END), 6) AS spend_last_30_days FROM events GROUP BY 1),
z AS (SELECT user_id, count(*) AS sessions, round(avg(epoch_us(b) - epoch_us(a)) / 1000000, 6) AS avg_session_seconds,
 round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) AS bounce_rate,
 round(count(*) FILTER (WHERE clicks > 0 AND buys = 0) * 1.0 / nullif(count(*) FILTER (WHERE clicks > 0), 0), 6) AS abandonment_rate FROM s GROUP BY 1)
SELECT * FROM w JOIN z USING (user_id)""",
)
def _(t):
    return plain(X.user_feature_table(t.events, "user_id", "ts", "event_type", "value", {k: k for k in TYPES}), 6)


@query("i44_drop_id_columns", "SELECT c_name, round(c_acctbal, 4) AS c_acctbal, c_mktsegment FROM customer")
def _(t):
    return plain(X.drop_id_columns(t.customer))


@query(
    "i45_rfm_segments",
    """WITH p AS (SELECT o_custkey, date_diff('day', max(o_orderdate), (SELECT max(o_orderdate) FROM orders)) AS recency, count(*) AS frequency,
 round(sum(o_totalprice), 2) AS monetary FROM orders GROUP BY 1),
q AS (SELECT *, 6 - ntile(5) OVER (ORDER BY recency, o_custkey) AS r_score, ntile(5) OVER (ORDER BY frequency, o_custkey) AS f_score,
 ntile(5) OVER (ORDER BY monetary, o_custkey) AS m_score FROM p)
SELECT *, CAST(r_score AS VARCHAR) || f_score || m_score AS segment FROM q""",
)
def _(t):
    return plain(X.rfm_segments(t.orders, "o_custkey", "o_orderdate", "o_totalprice"))
