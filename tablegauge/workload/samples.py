"""Tables derived from the test data that hold what it lacks: nulls, repeats, constants, SQL texts.

Each helper has a twin that writes the same derivation as SQL.
"""

from pyspark.sql import functions as F


def holey_events(events):
    """Events with nulls in three columns."""
    return events.withColumns(
        {
            "value": F.when(F.col("value") >= 5, F.col("value")),
            "event_type": F.when(F.col("event_type") != "error", F.col("event_type")),
            "user_id": F.when(F.col("event_id") % 17 != 0, F.col("user_id")),
        }
    )


def sql_holey_events() -> str:
    return """WITH holey AS (SELECT event_id, ts, CASE WHEN event_id % 17 <> 0 THEN user_id END AS user_id,
 CASE WHEN event_type <> 'error' THEN event_type END AS event_type,
 CASE WHEN value >= 5 THEN value END AS value, props FROM events)
"""


DIRTY_COLUMNS = (
    "l_orderkey", "l_partkey", "l_linenumber", "quantity", "discount", "tax", "unit_price", "l_returnflag",
    "batch", "empty_text", "ship_day",
)
DIRTY_NUMERIC = DIRTY_COLUMNS[:7]
DIRTY_TEXT = DIRTY_COLUMNS[7:]


def dirty_lineitem(lineitem):
    """Lineitem with nulls at three rates, a constant, an all-null column, negatives and repeated rows."""
    null = F.lit(None)
    base = lineitem.select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_suppkey") % 2 != 0, F.col("l_discount")).alias("discount"),
        F.when(F.col("l_partkey") % 20 != 0, F.col("l_tax")).alias("tax"),
        F.when(F.col("l_orderkey") % 50 == 0, -F.col("l_extendedprice"))
        .when(F.col("l_orderkey") % 499 == 0, F.col("l_extendedprice") * 20)
        .otherwise(F.col("l_extendedprice"))
        .alias("unit_price"),
        "l_returnflag",
        F.lit("A").alias("batch"),
        null.cast("string").alias("empty_text"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_day"),
    )
    return base.unionByName(base.filter(F.col("l_returnflag") == "R"))


SQL_DIRTY = """dirty0 AS (SELECT l_orderkey, l_partkey, l_linenumber,
 CASE WHEN l_partkey % 5 <> 0 THEN l_quantity END AS quantity,
 CASE WHEN l_suppkey % 2 <> 0 THEN l_discount END AS discount,
 CASE WHEN l_partkey % 20 <> 0 THEN l_tax END AS tax,
 CASE WHEN l_orderkey % 50 = 0 THEN -l_extendedprice WHEN l_orderkey % 499 = 0 THEN l_extendedprice * 20
   ELSE l_extendedprice END AS unit_price,
 l_returnflag, 'A' AS batch, CAST(NULL AS VARCHAR) AS empty_text, strftime(l_shipdate, '%Y-%m-%d') AS ship_day
 FROM lineitem),
dirty AS (SELECT * FROM dirty0 UNION ALL SELECT * FROM dirty0 WHERE l_returnflag = 'R')"""
