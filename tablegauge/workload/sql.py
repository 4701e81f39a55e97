"""Guarded SQL: the runner, the bulk audit, and the statement families users run."""

from pyspark.sql import functions as F

from tablegauge.operators import relational as J
from tablegauge.operators import sqlguard as G
from tablegauge.plans.quantiles import quantiles
from tablegauge.plans.sketches import rank_error
from tablegauge.workload.registry import plain, query


def run(t, sql: str, *names: str):
    out = G.guarded_select(t.spark, sql, {n: getattr(t, n) for n in names})
    if out.frame is None:
        raise ValueError(out.reason)
    return out.frame


def family(name: str, tables: str, spark_sql: str, duck_sql: str | None = None, digits: int = 4):
    """Register a statement that goes through the guard; `duck_sql` where the dialects differ."""

    @query(name, duck_sql or spark_sql)
    def _(t):
        return plain(run(t, spark_sql, *tables.split()), digits)


@query(
    "f1_run_select",
    "SELECT event_id, user_id, round(value, 4) AS value, true AS truncated FROM events WHERE value > 1 ORDER BY event_id LIMIT 500",
)
def _(t):
    sql = "SELECT event_id, user_id, value FROM data WHERE value > 1 ORDER BY event_id"
    return plain(G.run_select(t.spark, sql, {"data": t.events}).frame)


# a query log: one statement per event, built from its columns; valid in both dialects
LOG = """CASE event_id % 12
 WHEN 0 THEN concat('SELECT * FROM ', event_type, ' LIMIT ', CAST(user_id AS STRING))
 WHEN 1 THEN concat('select user_id, value from events where value > ', CAST(user_id AS STRING))
 WHEN 2 THEN concat('DELETE FROM events WHERE event_id = ', CAST(event_id AS STRING))
 WHEN 3 THEN concat('SELECT user_id FROM events WHERE event_date > ''2024-01-', CAST(1 + user_id % 30 AS STRING), ''' LIMIT 10')
 WHEN 4 THEN concat('SELECT a FROM ', event_type, ' UNION SELECT b FROM t', CAST(user_id AS STRING))
 WHEN 5 THEN concat('WITH x AS (SELECT user_id FROM events UNION ALL SELECT 1) SELECT count(user_id) FROM x WHERE user_id = ', CAST(user_id AS STRING))
 WHEN 6 THEN concat('SELECT x FROM (SELECT x FROM (SELECT x FROM (SELECT ', CAST(user_id AS STRING), ' AS x) a) b) c')
 WHEN 7 THEN concat('SELECT created_at, ', event_type, ' FROM events WHERE month = ', CAST(user_id % 12 AS STRING), ' LIMIT 100')
 WHEN 8 THEN concat('insert into t', CAST(user_id AS STRING), ' select * from events; drop table t')
 WHEN 9 THEN concat('SELECT name FROM users WHERE note = ''grant access ', CAST(user_id AS STRING), '''')
 WHEN 10 THEN concat('SHOW TABLES LIKE ''', event_type, '''')
 ELSE '  ' END"""
BLOCK = {
    "strict": ("DELETE", "UPDATE", "DROP", "ALTER", "INSERT", "CREATE", "MERGE", "TRUNCATE", "EXEC", "EXECUTE", "GRANT", "REVOKE", "ATTACH", "DETACH", "COPY"),
    "basic": ("DELETE", "UPDATE", "DROP", "ALTER", "INSERT", "CREATE", "MERGE", "TRUNCATE", "EXEC", "EXECUTE"),
}
DUCK_LOG = f"log AS (SELECT event_id, event_type, {LOG} AS q FROM events)"


def duck_word(rules: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(upper(q), '\\b{w}\\b') THEN '{w}'" for w in BLOCK[rules]) + " END"


def duck_bare() -> str:
    """Text without literals, quoted names and comments, and then without parentheses, from the inside out."""
    out = "regexp_replace(upper(q), '''[^'']*''|\"[^\"]*\"|`[^`]*`|--[^\\n]*|/\\*([^*]|\\*+[^*/])*\\*+/', ' ', 'g')"
    for _ in range(6):
        out = f"regexp_replace({out}, '\\([^()]*\\)', ' ', 'g')"
    return out


DATE_WORDS = ("date", "timestamp", "created_at", "updated_at", "day", "month", "year")


def duck_audit(rules: str) -> str:
    no_date = " AND ".join(f"NOT contains(lower(q), '{w}')" for w in DATE_WORDS)
    strict = rules == "strict"
    warn = [
        ("regexp_matches(upper(q), '\\bSELECT\\s+\\*')", "select_star"),
        ("NOT regexp_matches(upper(q), '\\bLIMIT\\b')", "no_limit"),
    ]
    if strict:
        warn.append(("NOT regexp_matches(upper(q), '\\bWHERE\\b')", "no_where"))
    warn.append((f"({no_date})", "no_date"))
    if strict:
        warn.append(("(length(upper(q)) - length(replace(upper(q), 'SELECT', ''))) / 6 > 3", "complex"))
    listed = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for test, name in warn)
    return f"""{DUCK_LOG},
s1 AS (SELECT *, {duck_word(rules)} AS word, {duck_bare()} AS bare FROM log),
s2 AS (SELECT *, CASE WHEN trim(q) = '' THEN 'Empty' WHEN word IS NOT NULL THEN NULL
  WHEN NOT regexp_matches(bare, '^\\s*(SELECT|WITH)\\b') THEN 'Other'
  WHEN regexp_matches(bare, '\\b(UNION|INTERSECT|EXCEPT)\\b') THEN 'SetOperation' ELSE 'Select' END AS statement FROM s1),
s3 AS (SELECT *, CASE WHEN statement = 'Empty' THEN 'empty' WHEN word IS NOT NULL THEN word
  WHEN statement <> 'Select' THEN 'statement:' || statement END AS blocked_reason FROM s2),
audit AS (SELECT event_id, q, blocked_reason IS NULL AS is_safe, blocked_reason, statement,
  CASE WHEN blocked_reason IS NULL THEN concat_ws(',', {listed}) ELSE '' END AS warnings FROM s3)"""


def sql_log(t):
    return t.events.select("event_id", F.expr(LOG).alias("q"))


@query("f2_blocked_keyword", f"WITH {DUCK_LOG} SELECT event_id, {duck_word('strict')} AS word FROM log")
def _(t):
    return sql_log(t).select("event_id", G.blocked_keyword(F.col("q")).alias("word"))


@query("f3_audit_sql_log", f"WITH {duck_audit('strict')} SELECT * FROM audit")
def _(t):
    return plain(G.audit_sql_log(sql_log(t), "q"))


@query("f4_audit_profile", f"WITH {duck_audit('basic')} SELECT * FROM audit")
def _(t):
    return plain(G.audit_sql_log(sql_log(t), "q", "basic"))


@query(
    "f5_statement_kind",
    f"""WITH {DUCK_LOG}, s AS (SELECT event_id, q, {duck_bare()} AS bare FROM log)
SELECT event_id, CASE WHEN trim(q) = '' THEN 'Empty'
  WHEN len(list_filter(string_split(bare, ';'), lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^\\s*(SELECT|WITH)\\b'))) > 0 THEN 'Other'
  WHEN regexp_matches(bare, '\\b(UNION|INTERSECT|EXCEPT)\\b') THEN 'SetOperation' ELSE 'Select' END AS statement FROM s""",
)
def _(t):
    return G.add_statement_kind(sql_log(t), "q").select("event_id", "statement")


@query(
    "f6_warning_summary",
    f"""WITH {duck_audit('strict')}
SELECT 'warning' AS kind, w AS item, count(*) AS n FROM (SELECT unnest(string_split(warnings, ',')) AS w FROM audit WHERE warnings <> '') GROUP BY w
UNION ALL SELECT 'blocked', blocked_reason, count(*) FROM audit WHERE blocked_reason IS NOT NULL GROUP BY blocked_reason""",
)
def _(t):
    return G.warning_summary(G.audit_sql_log(sql_log(t), "q"))


family(
    "g1_projection",
    "orders",
    "SELECT * EXCEPT (o_orderpriority, o_orderdate), o_totalprice * 0.1 AS tax, upper(o_orderstatus) AS st FROM orders",
    "SELECT * EXCLUDE (o_orderpriority, o_orderdate) REPLACE (round(o_totalprice, 4) AS o_totalprice), round(o_totalprice * 0.1, 4) AS tax, upper(o_orderstatus) AS st FROM orders",
)
family(
    "g2_filter",
    "part",
    "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%red%' AND p_size BETWEEN 5 AND 30 AND p_type IN ('SMALL','ECONOMY') AND p_brand IS NOT NULL AND NOT p_size = 7",
)
family(
    "g3_group_by",
    "lineitem",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total,
 count(*) FILTER (WHERE l_discount > 0.05) AS discounted FROM lineitem GROUP BY ALL HAVING count(*) > 10""",
)
family(
    "g4_grouping_sets",
    "lineitem",
    """SELECT l_returnflag, l_linestatus, 'rollup' AS k, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
UNION ALL SELECT l_returnflag, l_linestatus, 'cube', count(*) FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
UNION ALL SELECT l_returnflag, l_linestatus, 'sets', count(*) FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))""",
)
@query(
    "g5_distinct",
    # the sketch is held to three times its stated error
    """SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, true AS near FROM lineitem GROUP BY l_returnflag""",
)
def _(t):
    d = run(t, "SELECT DISTINCT l_returnflag, l_suppkey, l_partkey FROM lineitem", "lineitem")
    found = J.grouped_distinct(
        d, ["l_returnflag"], {"suppliers": "l_suppkey", "parts": "l_partkey"}, {"about": F.approx_count_distinct("l_suppkey", 0.01)})
    near = F.abs(F.col("about") - F.col("suppliers")) <= 0.03 * F.col("suppliers")
    return plain(found.select("l_returnflag", "suppliers", "parts", near.alias("near")))


family(
    "g6_top_k",
    "orders",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25",
    "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25",
)
family(
    "g7_joins",
    "orders customer nation",
    """SELECT 'inner' AS kind, count(*) AS n, count(n_name) AS named FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'left', count(*), count(o_orderkey) FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000
UNION ALL SELECT 'right', count(*), count(c_custkey) FROM customer RIGHT JOIN orders ON c_custkey = o_custkey AND c_acctbal > 0
UNION ALL SELECT 'full', count(*), count(c_custkey) FROM customer FULL JOIN orders ON c_custkey = o_orderkey
UNION ALL SELECT 'self', count(*), count(b.n_name) FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
UNION ALL SELECT 'semi', count(*), count(c_custkey) FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey
UNION ALL SELECT 'anti', count(*), count(c_custkey) FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey""",
    """SELECT 'inner' AS kind, count(*) AS n, count(n_name) AS named FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'left', count(*), count(o_orderkey) FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000
UNION ALL SELECT 'right', count(*), count(c_custkey) FROM customer RIGHT JOIN orders ON c_custkey = o_custkey AND c_acctbal > 0
UNION ALL SELECT 'full', count(*), count(c_custkey) FROM customer FULL JOIN orders ON c_custkey = o_orderkey
UNION ALL SELECT 'self', count(*), count(b.n_name) FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
UNION ALL SELECT 'semi', count(*), count(c_custkey) FROM customer SEMI JOIN orders ON c_custkey = o_custkey
UNION ALL SELECT 'anti', count(*), count(c_custkey) FROM customer ANTI JOIN orders ON c_custkey = o_custkey""",
)


@query(
    "g8_range_join",
    """WITH d AS (SELECT DISTINCT date_trunc('week', o_orderdate) AS wk FROM orders)
SELECT strftime(wk, '%Y-%m-%d') AS wk, count(*) AS n, round(sum(l_quantity), 2) AS qty
FROM lineitem JOIN d ON l_shipdate >= wk AND l_shipdate < wk + INTERVAL 14 DAY GROUP BY wk""",
)
def _(t):
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    weeks = t.orders.select(F.to_date(F.date_trunc("week", "o_orderdate")).alias("wk")).distinct()
    weeks = weeks.withColumns({"low": day(F.col("wk")), "high": day(F.col("wk")) + 14})
    lines = t.lineitem.select("l_quantity", day(F.col("l_shipdate")).alias("ship"))
    joined = J.range_join(lines, weeks, F.col("ship"), F.col("low"), F.col("high"), 14)
    return plain(
        joined.groupBy("wk").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    )


@query(
    "g9_asof_join",
    """WITH p AS (SELECT user_id, ts AS p_ts, event_id AS click_id, value AS click_value FROM events WHERE event_type = 'click'),
e AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase')
SELECT e.event_id, p.click_id, round(p.click_value, 4) AS click_value FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.p_ts""",
)
def _(t):
    e = t.events
    clicks = e.filter("event_type = 'click'").select(
        "user_id", F.col("ts").alias("p_ts"), F.col("event_id").alias("click_id"), F.col("value").alias("click_value")
    )
    buys = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    out = J.asof_join(buys, clicks, ["user_id"], "ts", "p_ts", ["click_id", "click_value"])
    return plain(out.select("event_id", "click_id", "click_value"))


family(
    "g10_subqueries",
    "orders customer",
    """WITH big AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey)
SELECT c_custkey, top FROM customer JOIN big ON c_custkey = o_custkey
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderstatus = 'F')
 AND c_nationkey IN (SELECT c2.c_nationkey FROM customer c2 WHERE c2.c_acctbal > 9000)
 AND top > (SELECT avg(o.o_totalprice) FROM orders o WHERE o.o_custkey = c_custkey)""",
    """WITH big AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey)
SELECT c_custkey, round(top, 4) AS top FROM customer JOIN big ON c_custkey = o_custkey
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderstatus = 'F')
 AND c_nationkey IN (SELECT c2.c_nationkey FROM customer c2 WHERE c2.c_acctbal > 9000)
 AND big.top > (SELECT avg(o.o_totalprice) FROM orders o WHERE o.o_custkey = c_custkey)""",
)
family(
    "g11_set_operations",
    "events orders",
    """SELECT 'union' AS k, count(*) AS n FROM (SELECT user_id FROM events UNION SELECT o_custkey FROM orders) a
UNION ALL SELECT 'union_all', count(*) FROM (SELECT user_id FROM events UNION ALL SELECT o_custkey FROM orders) a
UNION ALL SELECT 'intersect', count(*) FROM (SELECT user_id FROM events INTERSECT SELECT o_custkey FROM orders) a
UNION ALL SELECT 'intersect_all', count(*) FROM (SELECT user_id FROM events INTERSECT ALL SELECT o_custkey FROM orders) a
UNION ALL SELECT 'except', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT user_id FROM events) a
UNION ALL SELECT 'except_all', count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT user_id FROM events) a""",
)
# windows over per-day sums, so a busy user is a few rows per day
WINDOWS = """WITH d AS (SELECT user_id, {day} AS dd, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2)
SELECT user_id, {show} AS dd, row_number() OVER w AS rn, rank() OVER (PARTITION BY user_id ORDER BY n DESC) AS rk,
 dense_rank() OVER (PARTITION BY user_id ORDER BY n DESC) AS dr, ntile(4) OVER w AS quarter,
 lag(n) OVER w AS before, lead(n) OVER w AS after, first_value(n) OVER w AS first_n,
 round(sum(v) OVER w, 4) AS running, sum(n) OVER ({frame}) AS week_n FROM d
WINDOW w AS (PARTITION BY user_id ORDER BY dd)"""
family(
    "g12_windows",
    "events",
    WINDOWS.format(
        day="CAST(ts AS DATE)", show="date_format(dd, 'yyyy-MM-dd')",
        frame="PARTITION BY user_id ORDER BY datediff(dd, DATE'2024-01-01') RANGE BETWEEN 6 PRECEDING AND CURRENT ROW",
    ),
    WINDOWS.format(
        day="CAST(ts AS DATE)", show="strftime(dd, '%Y-%m-%d')",
        frame="PARTITION BY user_id ORDER BY date_diff('day', DATE '2024-01-01', dd) RANGE BETWEEN 6 PRECEDING AND CURRENT ROW",
    ).replace("sum(n) OVER", "CAST(sum(n) OVER").replace("CURRENT ROW)", "CURRENT ROW) AS BIGINT)"),
)
family(
    "g13_pivot",
    "lineitem",
    """SELECT l_returnflag, status, n FROM (
 SELECT * FROM (SELECT l_returnflag, l_linestatus FROM lineitem) PIVOT (count(*) FOR l_linestatus IN ('O' AS open, 'F' AS filled)))
UNPIVOT (n FOR status IN (open, filled))""",
    """SELECT l_returnflag, CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'filled' END AS status, count(*) AS n FROM lineitem
WHERE l_linestatus IN ('O', 'F') GROUP BY 1, 2""",
)
@query(
    "g14_statistics",
    """SELECT p_brand, round(quantile_cont(p_retailprice, 0.9), 4) AS p90, round(median(p_retailprice), 4) AS med, round(stddev(p_retailprice), 4) AS sd,
 round(corr(p_retailprice, p_size), 4) AS c, arg_max(p_partkey, p_retailprice * 1000000 + p_partkey) AS dearest FROM part GROUP BY p_brand""",
)
def _(t):
    found = J.grouped_statistics(t.part, ["p_brand"], "p_retailprice", {"p90": 0.9, "med": 0.5}, {
        "sd": F.stddev("p_retailprice"), "c": F.corr("p_retailprice", "p_size"),
        "dearest": F.max_by("p_partkey", F.col("p_retailprice") * 1000000 + F.col("p_partkey"))})
    return plain(found)


# a sketch: its quantiles' ranks in their group are held to the stated error
@query("g14_statistics_sketch", "SELECT l_returnflag, CAST(prob AS DOUBLE) AS prob, true AS near FROM (SELECT DISTINCT l_returnflag FROM lineitem), (SELECT unnest([0.5, 0.9]) AS prob)")
def _(t):
    lines = t.lineitem.select("l_returnflag", "l_extendedprice")
    guess = quantiles(lines, ["l_extendedprice"], [0.5, 0.9], ["l_returnflag"], exact=False)
    ranked = lines.join(F.broadcast(guess.drop("column")), "l_returnflag").groupBy("l_returnflag", "prob").agg(
        (F.avg((F.col("l_extendedprice") < F.col("quantile")).cast("double")) - F.col("prob")).alias("below"),
        (F.avg((F.col("l_extendedprice") <= F.col("quantile")).cast("double")) - F.col("prob")).alias("upto"))
    off = rank_error()
    return ranked.select("l_returnflag", "prob", ((F.col("below") <= off) & (F.col("upto") >= -off)).alias("near"))


family(
    "g15_strings",
    "part",
    """SELECT p_partkey, lower(p_type) AS t, substring(p_name, 1, 3) AS head, split(p_name, ' ')[1] AS word2,
 regexp_extract(p_brand, '#([0-9]+)', 1) AS brand_no, concat_ws('/', p_brand, p_type) AS tag, length(p_name) AS len, replace(p_name, 'e', 'E') AS rep FROM part""",
    """SELECT p_partkey, lower(p_type) AS t, substring(p_name, 1, 3) AS head, string_split(p_name, ' ')[2] AS word2,
 regexp_extract(p_brand, '#([0-9]+)', 1) AS brand_no, concat_ws('/', p_brand, p_type) AS tag, length(p_name) AS len, replace(p_name, 'e', 'E') AS rep FROM part""",
)
family(
    "g16_dates",
    "orders",
    """SELECT date_format(date_trunc('month', o_orderdate), 'yyyy-MM') AS m, datediff(max(o_orderdate), min(o_orderdate)) AS span,
 date_format(max(o_orderdate) + INTERVAL 10 DAYS, 'yyyy-MM-dd') AS due, count(*) AS n FROM orders GROUP BY 1""",
    """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS m, date_diff('day', min(o_orderdate), max(o_orderdate)) AS span,
 strftime(max(o_orderdate) + INTERVAL 10 DAY, '%Y-%m-%d') AS due, count(*) AS n FROM orders GROUP BY 1""",
)
family(
    "g17_expressions",
    "lineitem",
    """SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_discount, 0) AS q, CASE WHEN l_tax > 0.05 THEN 'hi' ELSE 'lo' END AS tax,
 coalesce(nullif(l_returnflag, 'N'), '-') AS flag, try_cast(l_returnflag AS INT) AS bad, abs(l_quantity - 25) AS d, floor(l_extendedprice) AS fl, sqrt(l_quantity) AS root FROM lineitem""",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_extendedprice / nullif(l_discount, 0), 4) AS q, CASE WHEN l_tax > 0.05 THEN 'hi' ELSE 'lo' END AS tax,
 coalesce(nullif(l_returnflag, 'N'), '-') AS flag, CAST(try_cast(l_returnflag AS INT) AS BIGINT) AS bad, abs(l_quantity - 25) AS d, CAST(floor(l_extendedprice) AS BIGINT) AS fl, round(sqrt(l_quantity), 4) AS root FROM lineitem""",
)
family(
    "g18_nested",
    "embeddings",
    """SELECT vec_id, pos, x FROM (SELECT vec_id, posexplode(transform(embedding, v -> CAST(v AS DOUBLE) * 2)) AS (pos, x) FROM embeddings) WHERE x > 0""",
    """SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(x, 4) AS x FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE * 2 AS x FROM embeddings) s WHERE s.x > 0""",
)
family(
    "g19_json",
    "events",
    "SELECT CAST(get_json_object(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS v FROM events GROUP BY 1",
    "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS v FROM events GROUP BY 1",
    6,
)


# which rows a sample takes is its own matter: held to its share, to rows of the table, and to the same rows again
@query(
    "g20_sampling",
    "SELECT l_returnflag, count(*) AS n_rows, true AS near_share, true AS same_again FROM lineitem GROUP BY l_returnflag",
)
def _(t):
    take = "SELECT l_returnflag, count(*) AS n, sum(l_orderkey) AS keys FROM lineitem TABLESAMPLE (10 PERCENT) REPEATABLE (7) GROUP BY l_returnflag"
    one, two = run(t, take, "lineitem"), run(t, take, "lineitem").select("l_returnflag", F.col("n").alias("n2"), F.col("keys").alias("keys2"))
    every = t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"))
    n = F.coalesce("n", F.lit(0))
    # within six deviations of a 10 % draw
    near = F.abs(n - 0.1 * F.col("n_rows")) <= 6 * F.sqrt(0.09 * F.col("n_rows"))
    again = F.col("n").eqNullSafe(F.col("n2")) & F.col("keys").eqNullSafe(F.col("keys2"))
    return every.join(one, "l_returnflag", "left").join(two, "l_returnflag", "left").select(
        "l_returnflag", "n_rows", near.alias("near_share"), again.alias("same_again"))
