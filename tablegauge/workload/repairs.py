"""Repairs named by the checks."""

from pyspark.sql import functions as F

from tablegauge.operators import repair as R
from tablegauge.workload.registry import plain, query
from tablegauge.workload.samples import SQL_DIRTY, dirty_lineitem, holey_events, sql_holey_events

HOLES = sql_holey_events()
KEYS = "l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS l_linenumber"


@query(
    "c10_impute",
    HOLES
    + """, fit AS (SELECT quantile_cont(value, 0.5) AS med, avg(value) AS mean FROM holey),
modes AS (SELECT event_type AS t FROM holey WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)
SELECT event_id, round(coalesce(value, (SELECT med FROM fit)), 4) AS by_median,
 round(coalesce(value, (SELECT mean FROM fit)), 4) AS by_mean,
 coalesce(event_type, (SELECT t FROM modes)) AS event_type FROM holey""",
)
def _(t):
    holey = holey_events(t.events).select("event_id", "event_type", "value", F.col("value").alias("by_mean"))
    out = R.impute(R.impute(R.impute(holey, ["value"]), ["by_mean"], "mean"), ["event_type"], "mode")
    return plain(out.withColumnRenamed("value", "by_median"))


@query(
    "c11_drop_null_rows",
    HOLES + "SELECT event_id, user_id, round(value, 4) AS value FROM holey WHERE user_id IS NOT NULL AND value IS NOT NULL",
)
def _(t):
    return plain(R.drop_null_rows(holey_events(t.events), ["user_id", "value"]).select("event_id", "user_id", "value"))


@query(
    "c12_drop_duplicate_rows",
    f"""WITH {SQL_DIRTY}, kept AS (SELECT DISTINCT * FROM dirty)
SELECT l_returnflag, count(*) AS n, round(sum(unit_price), 2) AS total FROM kept GROUP BY l_returnflag""",
)
def _(t):
    kept = R.drop_duplicate_rows(dirty_lineitem(t.lineitem))
    return kept.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("unit_price"), 2).alias("total")
    )


@query(
    "c13_drop_constant_columns",
    f"""WITH {SQL_DIRTY} SELECT {KEYS}, quantity, discount, tax, round(unit_price, 4) AS unit_price, l_returnflag, ship_day FROM dirty""",
)
def _(t):
    return plain(R.drop_constant_columns(dirty_lineitem(t.lineitem)))


@query(
    "c14_clip_iqr",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, round(least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 4) AS value FROM events, q""",
)
def _(t):
    return plain(R.clip_iqr(t.events.select("event_id", "value"), ["value"]))


@query("c15_log_transform", "SELECT event_id, round(ln(1 + value), 4) AS value FROM events")
def _(t):
    return plain(R.log_transform(t.events.select("event_id", "value"), ["value"]))


@query(
    "c16_target_encode",
    """WITH train AS (SELECT p_brand, p_retailprice FROM part WHERE p_size <= 40),
 m AS (SELECT avg(p_retailprice) AS a FROM train),
 e AS (SELECT p_brand, (sum(p_retailprice) + 10 * (SELECT a FROM m)) / (count(*) + 10) AS v FROM train GROUP BY p_brand)
SELECT p_partkey, p_brand, round(coalesce(v, (SELECT a FROM m)), 4) AS p_brand_encoded FROM part LEFT JOIN e USING (p_brand)""",
)
def _(t):
    part = t.part.select("p_partkey", "p_brand", "p_retailprice", "p_size")
    out = R.target_encode(part, "p_brand", "p_retailprice", part.filter("p_size <= 40"), smoothing=10.0)
    return plain(out.select("p_partkey", "p_brand", "p_brand_encoded"))


@query(
    "c17_hash_encode",
    """SELECT p_partkey, CAST('0x' || substr(md5(p_name), 1, 8) AS BIGINT) % 64 AS p_name_bucket FROM part""",
)
def _(t):
    return R.hash_encode(t.part, "p_name").select("p_partkey", "p_name_bucket")


@query(
    "c18_one_hot",
    "SELECT o_orderkey, "
    + ", ".join(f"CAST(o_orderstatus = '{v}' AS BIGINT) AS \"o_orderstatus_{v}\"" for v in "FOP")
    + " FROM orders",
)
def _(t):
    out = R.one_hot(t.orders, "o_orderstatus")
    return plain(out.select("o_orderkey", *[c for c in out.columns if c.startswith("o_orderstatus_")]))


@query(
    "c19_standard_scale",
    """SELECT c_custkey, round((c_acctbal - m) / s, 4) AS c_acctbal FROM customer,
(SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)""",
)
def _(t):
    return plain(R.standard_scale(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"]))
