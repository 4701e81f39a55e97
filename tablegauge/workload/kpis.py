"""KPIs and alert rules."""

from pyspark.sql import functions as F

from tablegauge.operators import alerts as A
from tablegauge.operators import kpi as K
from tablegauge.workload.registry import plain, query


def P(grain: str, col: str) -> str:
    return f"date_trunc('{grain}', {col})"


def show(period: str = "period") -> str:
    return f"strftime({period}, '%Y-%m-%d %H:%M:%S') AS period"


def series_sql(table: str, grain: str, ts: str, value: str) -> str:
    return f"SELECT {P(grain, ts)} AS period, {value} AS value FROM {table} GROUP BY 1"


def printed(inner: str, value: str = "round(value, 4) AS value", with_sql: str = "") -> str:
    return f"{with_sql}SELECT {show()}, {value} FROM ({inner})"


ERR = "event_type = 'error'"
def failed():
    return F.col("event_type") == "error"



@query(
    "h1_total_revenue",
    printed(
        series_sql(
            "lineitem", "day", "l_shipdate", "sum(l_extendedprice * (1 - l_discount))"
        )
    ),
)
def _(t):
    return plain(K.total_revenue(t.lineitem, F.col("l_extendedprice") * (1 - F.col("l_discount")), "l_shipdate"))


@query("h1_total_revenue_monthly", printed(series_sql("orders", "month", "o_orderdate", "sum(o_totalprice)")))
def _(t):
    return plain(K.total_revenue(t.orders, "o_totalprice", "o_orderdate", "month"))


@query(
    "h2_average_order_value",
    printed(series_sql("lineitem JOIN orders ON l_orderkey = o_orderkey", "month", "o_orderdate", "sum(l_extendedprice) / count(DISTINCT o_orderkey)"), "round(value, 6) AS value"),
)
def _(t):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return plain(K.average_order_value(lines, "l_extendedprice", "o_orderkey", "o_orderdate"), 6)


@query(
    "h3_repeat_purchase_rate",
    printed(f"SELECT period, avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END) AS value FROM (SELECT {P('month', 'o_orderdate')} AS period, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1"),
)
def _(t):
    return plain(K.repeat_purchase_rate(t.orders, "o_custkey", "o_orderdate"))


@query("h4_cancellation_rate", printed(series_sql("orders", "week", "o_orderdate", "avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END)")))
def _(t):
    return plain(K.status_rate(t.orders, F.col("o_orderstatus") == "P", "o_orderdate"))


@query("h5_monthly_active_customers", printed(series_sql("orders", "month", "o_orderdate", "count(DISTINCT o_custkey)"), "value"))
def _(t):
    return plain(K.active_entities(t.orders, "o_custkey", "o_orderdate"))


@query(
    "h6_customer_lifetime_value",
    """SELECT o_custkey, round(v, 6) AS order_value, round(f, 6) AS orders_per_month, round(m, 6) AS months, round(v * f * m, 2) AS value FROM (
SELECT o_custkey, sum(o_totalprice) / count(*) AS v, count(*) * 1.0 / count(DISTINCT date_trunc('month', o_orderdate)) AS f,
 CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) AS DOUBLE) / CAST(30.4375 AS DOUBLE) AS m FROM orders GROUP BY o_custkey)""",
)
def _(t):
    out = K.customer_lifetime_value(t.orders, "o_custkey", "o_totalprice", "o_orderdate")
    return plain(out.withColumn("value", F.round("value", 2)), 6)


@query(
    "h7_monthly_recurring_revenue",
    f"SELECT {show()}, round(sum(o_totalprice), 4) AS value, count(DISTINCT o_custkey) AS customers FROM (SELECT *, {P('month', 'o_orderdate')} AS period FROM orders) GROUP BY 1",
)
def _(t):
    return plain(K.monthly_recurring_revenue(t.orders, "o_custkey", "o_totalprice", "o_orderdate"))


CHURN = """WITH a AS (SELECT DISTINCT user_id, date_trunc('{g}', ts) AS period FROM events)
SELECT strftime(a.period, '%Y-%m-%d %H:%M:%S') AS period, round(avg(CASE WHEN b.user_id IS NULL THEN 1.0 ELSE 0.0 END), 4) AS value
FROM a LEFT JOIN a b ON a.user_id = b.user_id AND b.period = a.period + INTERVAL 1 {g}
WHERE a.period < (SELECT max(period) FROM a) GROUP BY a.period"""


@query("h8_churn_rate", CHURN.format(g="day"))
def _(t):
    return plain(K.churn_rate(t.events, "user_id", "ts", "day"))


@query("h8_churn_label", "SELECT round(avg(toxic), 4) AS value FROM labels")
def _(t):
    return plain(K.churn_share(t.labels, "toxic"))


@query(
    "h9_net_revenue_retention",
    """WITH a AS (SELECT o_custkey AS c, date_trunc('month', o_orderdate) AS p, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
j AS (SELECT a.p + INTERVAL 1 MONTH AS period, a.v, b.v AS nv FROM a LEFT JOIN a b ON a.c = b.c AND b.p = a.p + INTERVAL 1 MONTH WHERE a.p < (SELECT max(p) FROM a)),
s AS (SELECT period, sum(v) AS start, sum(CASE WHEN nv > v THEN nv - v ELSE 0 END) AS expansion, sum(CASE WHEN nv < v THEN v - nv ELSE 0 END) AS contraction,
 sum(CASE WHEN nv IS NULL THEN v ELSE 0 END) AS churned FROM j GROUP BY period)
SELECT strftime(period, '%Y-%m-%d %H:%M:%S') AS period, round(start, 4) AS start, round(expansion, 4) AS expansion, round(contraction, 4) AS contraction,
 round(churned, 4) AS churned, round((start + expansion - contraction - churned) / start, 4) AS value FROM s""",
)
def _(t):
    return plain(K.net_revenue_retention(t.orders, "o_custkey", "o_totalprice", "o_orderdate"))


SPEND = "spend AS (SELECT date_trunc('month', o_orderdate) AS period, sqrt(sum(o_totalprice)) * 100 AS spend FROM orders GROUP BY 1)"
NEW = "new AS (SELECT date_trunc('month', f) AS period, count(*) AS new_customers FROM (SELECT o_custkey, min(o_orderdate) AS f FROM orders GROUP BY 1) GROUP BY 1)"
CAC = f"{SPEND}, {NEW}, cac AS (SELECT period, spend, coalesce(new_customers, 0) AS new_customers, spend / nullif(coalesce(new_customers, 0), 0) AS value FROM spend LEFT JOIN new USING (period))"


def cac(t):
    revenue = K.total_revenue(t.orders, "o_totalprice", "o_orderdate", "month")
    spend = revenue.select("period", (F.sqrt("value") * 100).alias("spend"))
    return K.customer_acquisition_cost(t.orders, "o_custkey", "o_orderdate", spend)


@query(
    "h10_customer_acquisition_cost",
    f"WITH {CAC} SELECT {show()}, round(spend, 6) AS spend, new_customers, round(value, 6) AS value FROM cac",
)
def _(t):
    return plain(cac(t), 6)


@query("h11_transaction_volume", printed(series_sql("orders", "day", "o_orderdate", "count(o_orderkey)"), "value"))
def _(t):
    return plain(K.volume(t.orders, "o_orderdate", "day", counted="o_orderkey"))


@query("h12_failed_transaction_rate", printed(series_sql("events", "day", "ts", f"avg(CASE WHEN {ERR} THEN 1.0 ELSE 0.0 END)")))
def _(t):
    return plain(K.status_rate(t.events, failed(), "ts", "day"))


@query("h13_average_transaction_amount", printed(series_sql("orders", "month", "o_orderdate", "sum(o_totalprice) / count(o_orderkey)")))
def _(t):
    return plain(K.average_amount(t.orders, "o_totalprice", "o_orderdate", row_id="o_orderkey"))


@query(
    "h14_event_volume_by_type",
    f"SELECT {show()}, event_type, count(*) AS value FROM (SELECT *, {P('hour', 'ts')} AS period FROM events) GROUP BY ALL",
)
def _(t):
    return plain(K.volume(t.events, "ts", "hour", ["event_type"]))


@query("h15_failed_event_rate", printed(series_sql("events", "hour", "ts", f"avg(CASE WHEN {ERR} THEN 1.0 ELSE 0.0 END)")))
def _(t):
    return plain(K.status_rate(t.events, failed(), "ts", "hour"))


@query("h16_daily_active_users", printed(series_sql("events", "day", "ts", "count(DISTINCT user_id)"), "value"))
def _(t):
    return plain(K.active_entities(t.events, "user_id", "ts", "day"))


@query("h17_events_per_active_user", printed(series_sql("events", "day", "ts", "count(*) * 1.0 / count(DISTINCT user_id)")))
def _(t):
    return plain(K.events_per_active_user(t.events, "user_id", "ts"))


@query(
    "h18_onboarding_rate",
    """WITH u AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'signup') AS a, max(ts) FILTER (WHERE event_type = 'purchase') AS b FROM events GROUP BY 1)
SELECT strftime(date_trunc('day', a), '%Y-%m-%d %H:%M:%S') AS period, count(*) AS started, round(avg(CASE WHEN b >= a THEN 1.0 ELSE 0.0 END), 4) AS value
FROM u WHERE a IS NOT NULL GROUP BY 1""",
)
def _(t):
    step = lambda name: F.col("event_type") == name
    return plain(K.onboarding_rate(t.events, "user_id", "ts", step("signup"), step("purchase"), "day"))


@query(
    "h19_readmission_rate",
    """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d %H:%M:%S') AS period, round(avg(CASE WHEN EXISTS (
 SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderdate > a.o_orderdate AND b.o_orderdate <= a.o_orderdate + INTERVAL 30 DAY) THEN 1.0 ELSE 0.0 END), 4) AS value
FROM orders a GROUP BY 1""",
)
def _(t):
    return plain(K.readmission_rate(t.orders, "o_custkey", "o_orderdate"))


@query(
    "h20_average_length_of_stay",
    printed(series_sql("orders JOIN lineitem ON l_orderkey = o_orderkey", "month", "o_orderdate", "avg(date_diff('day', o_orderdate, l_shipdate))")),
)
def _(t):
    stays = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    return plain(K.average_length_of_stay(stays, "o_orderdate", "l_shipdate"))


@query("h21_no_show_rate", printed(series_sql("orders", "week", "o_orderdate", "avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END)")))
def _(t):
    return plain(K.status_rate(t.orders, F.col("o_orderstatus") == "F", "o_orderdate"))


@query(
    "h22_rate_by_status",
    f"""SELECT {show()}, o_orderstatus, n, round(n * 1.0 / sum(n) OVER (PARTITION BY p), 4) AS share FROM
(SELECT {P('day', 'o_orderdate')} AS p, {P('day', 'o_orderdate')} AS period, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)""",
)
def _(t):
    return plain(K.rate_by_status(t.orders, "o_orderstatus", "o_orderdate"))


FILLED = """c AS (SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM events), (SELECT date_trunc('hour', max(ts)) FROM events), INTERVAL 1 HOUR)) AS period),
v AS (SELECT date_trunc('hour', ts) AS period, CAST(count(*) AS DOUBLE) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1),
b AS (SELECT min(period) AS lo, max(period) AS hi FROM v)"""


@query(
    "h23_trend",
    f"WITH {FILLED} SELECT strftime(c.period, '%Y-%m-%d %H:%M:%S') AS period, coalesce(n, 0) AS value FROM c LEFT JOIN v USING (period), b WHERE c.period BETWEEN lo AND hi",
)
def _(t):
    return plain(K.trend(t.events.filter("event_type = 'purchase'"), "ts", "hour"))


def calendar_sql(series: str, grain: str) -> str:
    """s: the series with every period of a generated calendar, 0 where it has no row."""
    return f"""s0 AS ({series}), s AS (SELECT period, coalesce(value, 0) AS value FROM (SELECT unnest(generate_series(
 (SELECT min(period) FROM s0), (SELECT max(period) FROM s0), INTERVAL 1 {grain})) AS period) c LEFT JOIN s0 USING (period))"""


REV_DAY = calendar_sql(series_sql("orders", "day", "o_orderdate", "sum(o_totalprice)"), "day")
REV_MONTH = calendar_sql(series_sql("orders", "month", "o_orderdate", "sum(o_totalprice)"), "month")


@query(
    "h24_alert_vs_trailing_avg",
    f"""WITH {REV_DAY}, w AS (SELECT *, avg(value) OVER (ORDER BY period ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS trailing_avg FROM s)
SELECT {show()}, round(value, 4) AS value, round(trailing_avg, 4) AS trailing_avg FROM w WHERE value < 0.85 * trailing_avg""",
)
def _(t):
    return plain(A.alert_vs_trailing_avg(K.total_revenue(t.orders, "o_totalprice", "o_orderdate"), grain="day"))


CHANGE = "w AS (SELECT *, lag(value) OVER (ORDER BY period) AS previous FROM s), ch AS (SELECT *, (value - previous) / previous * 100 AS change_pct FROM w)"


@query(
    "h25_alert_period_change",
    f"WITH {REV_MONTH}, {CHANGE} SELECT {show()}, round(value, 4) AS value, round(previous, 4) AS previous, round(change_pct, 4) AS change_pct FROM ch WHERE change_pct < 5",
)
def _(t):
    return plain(A.alert_period_change(K.total_revenue(t.orders, "o_totalprice", "o_orderdate", "month"), 5.0, grain="month"))


@query(
    "h26_alert_level",
    f"WITH s AS ({series_sql('events', 'hour', 'ts', f'avg(CASE WHEN {ERR} THEN 1.0 ELSE 0.0 END)')}) SELECT {show()}, round(value, 4) AS value FROM s WHERE value > 0.05",
)
def _(t):
    return plain(A.alert_level(K.status_rate(t.events, failed(), "ts", "hour"), above=0.05))


@query(
    "h27_alert_vs_prior_week",
    f"""WITH {calendar_sql(series_sql('events', 'day', 'ts', 'count(DISTINCT user_id)'), 'day')}
SELECT strftime(a.period, '%Y-%m-%d %H:%M:%S') AS period, a.value, b.value AS week_before FROM s a JOIN s b ON b.period = a.period - INTERVAL 7 DAY WHERE a.value < 0.99 * b.value""",
)
def _(t):
    return plain(A.alert_vs_prior_week(K.active_entities(t.events, "user_id", "ts", "day"), 0.01, "day"))


@query(
    "h28_alert_dim_drop",
    f"""WITH s0 AS (SELECT event_type, {P('hour', 'ts')} AS period, count(*) AS value FROM events GROUP BY ALL),
c AS (SELECT event_type, unnest(generate_series(min(period), (SELECT max(period) FROM s0), INTERVAL 1 HOUR)) AS period FROM s0 GROUP BY event_type),
s AS (SELECT event_type, period, coalesce(value, 0) AS value FROM c LEFT JOIN s0 USING (event_type, period)),
w AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY period) AS previous FROM s)
SELECT event_type, {show()}, value, previous, round((value - previous) / previous * 100, 4) AS change_pct FROM w WHERE (value - previous) * 100.0 / previous < -30""",
)
def _(t):
    return plain(A.alert_dim_drop(K.volume(t.events, "ts", "hour", ["event_type"]), "event_type", grain="hour"))


@query(
    "h29_alert_kpi_ratio",
    f"""WITH {CAC}, v AS ({series_sql('orders', 'month', 'o_orderdate', 'sum(o_totalprice) / count(*)')})
SELECT strftime(cac.period, '%Y-%m-%d %H:%M:%S') AS period, round(cac.value, 6) AS cost, round(v.value, 6) AS worth FROM cac JOIN v USING (period) WHERE cac.value > 1.0 / 3 * v.value""",
)
def _(t):
    return plain(A.alert_kpi_ratio(cac(t), K.average_amount(t.orders, "o_totalprice", "o_orderdate")), 6)


@query(
    "h30_explain_change",
    f"""WITH {REV_MONTH}, {CHANGE}, f AS (SELECT *, CASE WHEN abs(change_pct) >= 25 THEN 'significant' WHEN abs(change_pct) >= 10 THEN 'moderate' ELSE 'minor' END AS severity,
 CASE WHEN abs(change_pct) < 1 THEN 'stable' WHEN change_pct > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM ch WHERE change_pct IS NOT NULL)
SELECT {show()}, round(value, 4) AS value, round(previous, 4) AS previous, round(change_pct, 4) AS change_pct, severity, direction,
 CASE WHEN direction = 'stable' THEN 'Total Revenue held steady' ELSE 'Total Revenue is ' || direction || ' (' || severity || ')' END AS explanation FROM f""",
)
def _(t):
    return plain(A.explain_change(K.total_revenue(t.orders, "o_totalprice", "o_orderdate", "month"), "total_revenue", grain="month"))


@query(
    "h31_year_over_year",
    f"""WITH {REV_MONTH} SELECT strftime(a.period, '%Y-%m-%d %H:%M:%S') AS period, round(a.value, 4) AS value, round(b.value, 4) AS year_before,
 round((a.value - b.value) / b.value * 100, 4) AS change_pct FROM s a JOIN s b ON b.period = a.period - INTERVAL 1 YEAR""",
)
def _(t):
    return plain(A.year_over_year(K.total_revenue(t.orders, "o_totalprice", "o_orderdate", "month")))


@query(
    "h32_change_drivers",
    f"""WITH s AS (SELECT o_orderpriority, {P('month', 'o_orderdate')} AS period, sum(o_totalprice) AS value FROM orders GROUP BY ALL),
j AS (SELECT coalesce(a.period, b.period + INTERVAL 1 MONTH) AS period, coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority,
 coalesce(a.value, 0) - coalesce(b.value, 0) AS delta FROM s a FULL JOIN s b ON b.period + INTERVAL 1 MONTH = a.period AND a.o_orderpriority = b.o_orderpriority),
k AS (SELECT *, delta / nullif(sum(delta) OVER (PARTITION BY period), 0) AS share, row_number() OVER (PARTITION BY period ORDER BY abs(delta) DESC, o_orderpriority) AS place
 FROM j WHERE period > (SELECT min(period) FROM s) AND period <= (SELECT max(period) FROM s))
SELECT {show()}, o_orderpriority, round(delta, 4) AS delta, round(share, 4) AS share, place FROM k WHERE place <= 3""",
)
def _(t):
    series = K.total_revenue(t.orders, "o_totalprice", "o_orderdate", "month", ["o_orderpriority"])
    return plain(A.change_drivers(series, "o_orderpriority"))
