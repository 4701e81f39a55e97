"""Chart datasets."""

from pyspark.sql import functions as F

from tablegauge.operators import charts as C
from tablegauge.workload.registry import plain, query
from tablegauge.workload.tables import NAMES

kind = lambda name: F.col("event_type") == name


@query(
    "l1_revenue_by_category",
    """WITH s AS (SELECT p_type, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT p_type, round(revenue, 4) AS revenue, round(revenue / (SELECT sum(revenue) FROM s), 4) AS share FROM s""",
)
def _(t):
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return plain(C.revenue_by_category(lines, "p_type", F.col("l_extendedprice") * (1 - F.col("l_discount"))))


STAGES = ("view", "click", "signup", "purchase")


@query(
    "l2_order_stage_funnel",
    " UNION ALL ".join(
        f"SELECT CAST({i + 1} AS BIGINT) AS place, '{s}' AS stage, count(DISTINCT user_id) FILTER (WHERE event_type = '{s}' AND value > 20) AS users, "
        f"round(count(DISTINCT user_id) FILTER (WHERE event_type = '{s}' AND value > 20) / count(DISTINCT user_id) FILTER (WHERE event_type = 'view' AND value > 20), 4) AS share_of_first FROM events"
        for i, s in enumerate(STAGES)
    ),
)
def _(t):
    return plain(C.stage_funnel(t.events, "user_id", {s: kind(s) & (F.col("value") > 20) for s in STAGES}))


@query(
    "l3_mrr_over_time",
    """WITH s AS (SELECT date_trunc('month', o_orderdate) AS p, sum(o_totalprice) AS value, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1)
SELECT strftime(p, '%Y-%m-%d %H:%M:%S') AS period, round(value, 4) AS value, customers, round(sum(value) OVER (ORDER BY p), 4) AS running FROM s""",
)
def _(t):
    return plain(C.mrr_over_time(t.orders, "o_custkey", "o_totalprice", "o_orderdate"))


COHORT = """WITH a AS (SELECT DISTINCT {u} AS u, date_trunc('{g}', {ts}) AS p FROM {t}), c AS (SELECT *, min(p) OVER (PARTITION BY u) AS cohort FROM a),
n AS (SELECT cohort, {age} AS age, count(*) AS users FROM c GROUP BY 1, 2)
SELECT strftime(cohort, '%Y-%m-%d %H:%M:%S') AS cohort, age, users, round(users / max(CASE WHEN age = 0 THEN users END) OVER (PARTITION BY cohort), 4) AS share FROM n"""


@query("l4_cohort_retention", COHORT.format(u="user_id", g="day", ts="ts", t="events", age="date_diff('day', cohort, p)"))
def _(t):
    return plain(C.cohort_retention(t.events, "user_id", "ts", "day"))


@query("l4_cohort_retention_monthly", COHORT.format(u="o_custkey", g="month", ts="o_orderdate", t="orders", age="date_diff('month', cohort, p)"))
def _(t):
    return plain(C.cohort_retention(t.orders, "o_custkey", "o_orderdate", "month"))


@query(
    "l5_activity_heatmap",
    "SELECT isodow(ts) - 1 AS weekday, hour(ts) AS hour, count(*) AS events FROM events GROUP BY 1, 2",
)
def _(t):
    return plain(C.activity_heatmap(t.events, "ts"))


@query("l6_engagement_vs_value", "SELECT user_id, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1")
def _(t):
    return plain(C.engagement_vs_value(t.events, "user_id", "value"))


@query(
    "l7_top_users",
    "SELECT o_custkey, count(*) AS events, round(sum(o_totalprice), 4) AS value FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 10",
)
def _(t):
    return plain(C.top_users(t.orders, "o_custkey", "o_totalprice"))


KINDS = ("view", "signup", "error", "click", "purchase")


@query(
    "l8_events_by_type_over_time",
    "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS period, "
    + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS \"{k}\"" for k in KINDS)
    + " FROM events GROUP BY 1",
)
def _(t):
    return plain(C.events_by_type_over_time(t.events, "ts", "event_type", KINDS))




@query(
    "l9_null_and_duplicate_rates",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS "table", CAST(0 AS DOUBLE) AS missing_percent, round(CAST(a - d AS DOUBLE) * 100 / a, 2) AS duplicate_percent
FROM (SELECT (SELECT count(*) FROM {n}) AS a, (SELECT count(*) FROM (SELECT DISTINCT * FROM {n})) AS d)"""
        for n in NAMES
    ),
)
def _(t):
    return C.table_rates({n: getattr(t, n) for n in NAMES})


@query(
    "l10_drill_down",
    """SELECT r_name, n_name, c_mktsegment, round(sum(o_totalprice), 4) AS value, count(*) AS n,
 CAST(bit_count(grouping_id(r_name, n_name, c_mktsegment)) AS BIGINT) AS level
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""",
)
def _(t):
    joined = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return plain(C.drill_down(joined, ["r_name", "n_name", "c_mktsegment"], "o_totalprice"))
