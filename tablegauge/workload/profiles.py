"""Profiling and data dictionary."""

from pyspark.sql import functions as F

from tablegauge.operators import profile as P
from tablegauge.plans import sketches as K
from tablegauge.session import new_folder
from tablegauge.workload.registry import plain, query
from tablegauge.workload.samples import holey_events, sql_holey_events

LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)
LINE_NUMERIC = LINE_COLUMNS[:8]
ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("b1_table_shape", "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM lineitem")
def _(t):
    return P.table_shape(t.lineitem)


HOLES = sql_holey_events()


@query(
    "b2_null_counts",
    HOLES
    + """
SELECT * FROM (
  SELECT 'value' AS "column", count(*) - count(value) AS nulls FROM holey
  UNION ALL SELECT 'event_type', count(*) - count(event_type) FROM holey
  UNION ALL SELECT 'user_id', count(*) - count(user_id) FROM holey
  UNION ALL SELECT 'props', count(*) - count(props) FROM holey) WHERE nulls > 0""",
)
def _(t):
    return P.null_counts(holey_events(t.events))


@query(
    "b3_missing_summary",
    HOLES
    + """
SELECT CAST(cells AS BIGINT) AS missing_cells, round(cells * 100.0 / (n * 6), 2) AS missing_percent FROM (
  SELECT count(*) AS n, 4 * count(*) - count(value) - count(event_type) - count(user_id) - count(props) AS cells
  FROM holey)""",
)
def _(t):
    return P.missing_summary(holey_events(t.events))


@query(
    "b4_duplicate_row_count",
    "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT text, count(*) AS n FROM documents GROUP BY text)",
)
def _(t):
    return P.duplicate_row_count(t.documents, ["text"])


def _stats_sql(table: str, columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, count(*) - count({c}) AS nulls FROM {table}"""
        for c in columns
    )


@query("b5_numeric_stats", _stats_sql("lineitem", LINE_NUMERIC))
def _(t):
    return plain(P.numeric_stats(t.lineitem))


@query(
    "b6_sample_rows",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 4) AS l_extendedprice,
strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate
FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 5""",
)
def _(t):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    return plain(P.sample_rows(t.lineitem.select(cols), cols[:5]))


@query(
    "b7_profile_table",
    f"""
WITH s AS ({_stats_sql('lineitem', LINE_NUMERIC)}),
d AS (SELECT CAST(sum(n - 1) AS DOUBLE) AS v, CAST(sum(n) AS DOUBLE) AS n FROM
  (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(LINE_COLUMNS)}))
SELECT "column", 'min' AS metric, min AS value FROM s UNION ALL SELECT "column", 'max', max FROM s
UNION ALL SELECT "column", 'mean', mean FROM s UNION ALL SELECT "column", 'std', std FROM s
UNION ALL SELECT '*', 'rows', n FROM d UNION ALL SELECT '*', 'columns', 11.0
UNION ALL SELECT '*', 'missing_cells', 0.0 UNION ALL SELECT '*', 'missing_percent', 0.0
UNION ALL SELECT '*', 'duplicate_rows', v FROM d""",
)
def _(t):
    return plain(P.profile_table(t.lineitem))


@query(
    "b8_column_samples",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", string_agg(v, ',' ORDER BY k, v) AS samples FROM
(SELECT CAST({c} AS VARCHAR) AS v, min(o_orderkey) AS k FROM orders WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2, 1 LIMIT 5)"""
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    ),
)
def _(t):
    return plain(
        P.column_samples(
            t.orders, "o_orderkey", columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
        )
    )


@query(
    "b9_distinct_counts",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_values FROM lineitem""" for c in LINE_COLUMNS
    ),
)
def _(t):
    return P.distinct_counts(t.lineitem)


# one sketch per part and column, stored part by part; held to the stated error of the merged count
@query(
    "b9_distinct_states",
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS exact, true AS near FROM events""" for c in ("user_id", "event_type", "props", "event_id")),
)
def _(t):
    names, folder = ["user_id", "event_type", "props", "event_id"], new_folder(t.spark, "states")
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    for part, rows in (("first", t.events.filter(F.col("ts") < middle)), ("second", t.events.filter(F.col("ts") >= middle))):
        K.store_states(K.distinct_states(rows, names), folder, part)
    merged = K.merged_distinct(K.stored_states(t.spark, folder)).withColumnRenamed("distinct_values", "guess")
    both = P.distinct_counts(t.events, names).join(F.broadcast(merged), "column")
    off = F.abs(F.col("guess") - F.col("distinct_values")) <= K.distinct_error() * F.col("distinct_values")
    return both.select("column", F.col("distinct_values").alias("exact"), off.alias("near"))


MEANING = """CASE
 WHEN contains(c,'id') OR contains(c,'key') OR contains(c,'uuid') OR contains(c,'guid') THEN 'identifier'
 WHEN contains(c,'date') OR contains(c,'time') OR contains(c,'created') OR contains(c,'updated') THEN 'date'
 WHEN contains(c,'revenue') OR contains(c,'amount') OR contains(c,'price') OR contains(c,'cost') OR contains(c,'fee') THEN 'money'
 WHEN contains(c,'status') OR contains(c,'state') OR contains(c,'type') OR contains(c,'category') OR contains(c,'label') THEN 'category'
 WHEN contains(c,'count') OR contains(c,'qty') OR contains(c,'quantity') OR contains(c,'total') OR contains(c,'num') THEN 'count'
 WHEN contains(c,'name') OR contains(c,'title') OR contains(c,'description') OR contains(c,'text') OR contains(c,'comment') THEN 'text'
 ELSE 'unclear' END"""


@query(
    "b10_column_meaning",
    f"""SELECT meaning, count(*) AS n FROM (SELECT {MEANING} AS meaning FROM
(SELECT lower(unnest(regexp_split_to_array(text, '[ \\n]+'))) AS c FROM documents)) GROUP BY meaning""",
)
def _(t):
    names = t.documents.select(F.explode(F.split("text", "[ \n]+")).alias("column"))
    return P.column_meaning(names).groupBy("meaning").agg(F.count(F.lit(1)).alias("n"))


def _facts_sql(table: str, cols, key: str) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT {i} AS ordinal, '{c}' AS "column", '{kd}' AS kind, {str(whole).lower()} AS whole,
count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values FROM {table}"""
        for i, (c, kd, whole) in enumerate(cols)
    )
    return f"""facts AS ({parts}), named AS (SELECT *, lower("column") AS c FROM facts),
flags AS (SELECT *, {MEANING} AS meaning,
 (contains(c,'id') OR contains(c,'key') OR contains(c,'uuid') OR contains(c,'guid')) AS is_likely_id,
 (contains(c,'date') OR contains(c,'time')) AS is_likely_date FROM named)"""


EVENT_COLUMNS = (
    ("event_id", "numeric", True), ("ts", "temporal", False), ("user_id", "numeric", True),
    ("event_type", "string", False), ("value", "numeric", False), ("props", "string", False),
    ("level", "numeric", True), ("level_gaps", "numeric", True),
)
LEVELS_SQL = """levels AS (SELECT *, CASE WHEN value > 10 THEN 2 ELSE 1 END AS level,
 CASE WHEN value > 20 THEN 1 WHEN value > 5 THEN 2 END AS level_gaps FROM events)"""


def levels(events):
    return events.withColumns(
        {
            "level": F.when(F.col("value") > 10, 2).otherwise(1),
            "level_gaps": F.when(F.col("value") > 20, 1).when(F.col("value") > 5, 2),
        }
    )


@query(
    "b11_column_role_flags",
    f"""WITH {LEVELS_SQL}, {_facts_sql('levels', EVENT_COLUMNS, 'event_id')}
SELECT "column", is_likely_id, is_likely_date,
 ((kind IN ('string','temporal') OR (distinct_values < 20 AND whole AND nulls = 0)) AND NOT is_likely_id) AS is_likely_categorical
FROM flags""",
)
def _(t):
    facts = P.column_facts(levels(t.events))
    return P.column_role_flags(facts).select("column", "is_likely_id", "is_likely_date", "is_likely_categorical")


ORDER_KINDS = (
    ("o_orderkey", "numeric", True), ("o_custkey", "numeric", True), ("o_orderstatus", "string", False),
    ("o_totalprice", "numeric", False), ("o_orderdate", "temporal", False), ("o_orderpriority", "string", False),
)


@query(
    "b12_data_dictionary",
    f"""WITH {_facts_sql('orders', ORDER_KINDS, 'o_orderkey')}, samples AS ("""
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", string_agg(v, ',' ORDER BY k, v) AS samples FROM
(SELECT CAST({c} AS VARCHAR) AS v, min(o_orderkey) AS k FROM orders GROUP BY 1 ORDER BY 2, 1 LIMIT 5)"""
        for c, _, _ in ORDER_KINDS
    )
    + """)
SELECT CAST(ordinal AS BIGINT) AS ordinal, "column", kind, nulls, distinct_values, meaning, is_likely_id, is_likely_date,
 ((kind IN ('string','temporal') OR (distinct_values < 20 AND whole AND nulls = 0)) AND NOT is_likely_id) AS is_likely_categorical, samples
FROM flags JOIN samples USING ("column")""",
)
def _(t):
    return plain(P.data_dictionary(t.orders, "o_orderkey").drop("dtype"))


@query(
    "b13_column_summary_median",
    """SELECT round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std,
min(l_extendedprice) AS min, max(l_extendedprice) AS max, count(l_extendedprice) AS count,
round(quantile_cont(l_extendedprice, 0.5), 4) AS median FROM lineitem""",
)
def _(t):
    return plain(P.column_summary(t.lineitem, "l_extendedprice"))


# quantiles of sketches that were stored part by part; their ranks are held to the stated error
@query(
    "b13_quantile_states",
    "SELECT c AS \"column\", CAST(p AS DOUBLE) AS prob, true AS near FROM (SELECT unnest(['l_extendedprice', 'l_quantity', 'l_discount']) AS c), (SELECT unnest([0.25, 0.5, 0.75, 0.99]) AS p)",
)
def _(t):
    names, folder, probs = ["l_extendedprice", "l_quantity", "l_discount"], new_folder(t.spark, "states"), [0.25, 0.5, 0.75, 0.99]
    for part in ("A", "N", "R"):
        K.store_states(K.quantile_states(t.lineitem.filter(F.col("l_returnflag") == part), names), folder, part)
    guess = K.merged_quantiles(K.stored_states(t.spark, folder), probs)
    cells = t.lineitem.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in names])))
    ranked = cells.join(F.broadcast(guess), "column").groupBy("column", "prob").agg(
        F.avg((F.col("v") < F.col("quantile")).cast("double")).alias("below"), F.avg((F.col("v") <= F.col("quantile")).cast("double")).alias("upto"))
    off = K.rank_error()
    return ranked.select("column", "prob", ((F.col("below") - off <= F.col("prob")) & (F.col("upto") + off >= F.col("prob"))).alias("near"))
