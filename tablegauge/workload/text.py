"""Request, conversation and report jobs (K1-K9)."""

from pyspark.sql import functions as F

from tablegauge.functions import fixed_values as V
from tablegauge.operators import charts as C
from tablegauge.operators import kpi as K
from tablegauge.operators import matching as M
from tablegauge.operators import profile as P
from tablegauge.operators import quality as Q
from tablegauge.operators import textjobs as X
from tablegauge.workload.kpis import P as period_sql
from tablegauge.workload.matching import CATALOG, JOINED, any_of, catalog, joined_score
from tablegauge.workload.profiles import _stats_sql
from tablegauge.workload.registry import plain, query

# requests: every message, with a phrase by its turn so that each intent occurs
PHRASES = (
    "", "Create a KPI dashboard", "train a model", "Write a SQL query", "find missing values", "design the pipeline",
    "Explore the data", "join tables and forecast churn", "report on quality",
)
ASK = "concat(text, ' ', CASE (conv_id * 3 + turn) % 9 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + " END)"
REQUESTS = f"q AS (SELECT conv_id, turn, lower({ASK}) AS t FROM conversations)"


def requests(t):
    return t.conversations.select("conv_id", "turn", F.expr(ASK).alias("ask"))


def count_of(words) -> str:
    return " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in words)


CLASSIFIED = f"""{REQUESTS}, m AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {any_of('t', w)} THEN '{n}' END" for n, w in V.INTENTS)}], lambda x: x IS NOT NULL) AS cats,
 {' + '.join(count_of(w) for _, w in V.INTENTS)} AS hits FROM q),
k AS (SELECT *, CASE len(cats) WHEN 0 THEN 'analytics' WHEN 1 THEN cats[1] ELSE 'mixed' END AS intent FROM m),
r AS (SELECT *, CASE intent WHEN 'data_science' THEN 'scientist' WHEN 'architecture' THEN 'supervisor' WHEN 'mixed' THEN 'supervisor' ELSE 'analyst' END AS route FROM k)"""


@query(
    "k1_classify_requests",
    f"WITH {CLASSIFIED} SELECT conv_id, turn, intent, route, array_to_string(cats, ',') AS matched, CAST(hits AS BIGINT) AS keyword_hits FROM r",
)
def _(t):
    return plain(X.classify_requests(requests(t), "ask").drop("ask"))


@query("k2_intent_counts", f"WITH {CLASSIFIED} SELECT intent, route, count(*) AS n FROM r GROUP BY ALL")
def _(t):
    return X.intent_counts(requests(t), "ask")


@query(
    "k3_plan_flags",
    f"""WITH {REQUESTS}, f AS (SELECT *, {any_of('t', V.SCIENTIST_WORDS)} AS needs_scientist, {any_of('t', V.ANALYST_WORDS)} AS a FROM q),
g AS (SELECT *, a OR NOT needs_scientist AS needs_analyst FROM f),
h AS (SELECT *, concat_ws(',', 'classify_request,context_usage', CASE WHEN needs_analyst THEN 'profile,quality_report,kpis,dashboard_data' END,
 CASE WHEN needs_analyst AND (contains(t, 'sql') OR contains(t, 'query')) THEN 'sql_audit' END,
 CASE WHEN needs_scientist THEN 'problem_type,ml_risks,features,evaluation_metrics,ml_plan' END, 'collect,section_check,combine') AS steps FROM g)
SELECT conv_id, turn, needs_analyst, needs_scientist, steps, len(string_split(steps, ',')) AS step_count FROM h""",
)
def _(t):
    return plain(X.plan_flags(requests(t), "ask").drop("ask"))


LINES = """l0 AS (SELECT conv_id, turn, string_split(CASE WHEN role = 'user' THEN 'USER: ' ELSE 'ASSISTANT: ' END || text, chr(10)) AS p FROM conversations),
l1 AS (SELECT conv_id, turn, generate_subscripts(p, 1) AS pos, unnest(p) AS raw FROM l0),
l AS (SELECT conv_id, turn, pos, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM l1)"""


@query(
    "k4_conversation_digest",
    f"""WITH {LINES}, n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS c FROM l WHERE line <> ''
 WINDOW w AS (PARTITION BY conv_id ORDER BY turn, pos)),
e AS (SELECT conv_id, i * 2 AS o, line FROM n WHERE c <= 6 OR i <= 3 OR i > c - 3 UNION ALL SELECT DISTINCT conv_id, 7, '[... earlier messages ...]' FROM n WHERE c > 6),
d AS (SELECT conv_id, substr(string_agg(line, ' | ' ORDER BY o), 1, 300) AS condensed FROM e GROUP BY 1),
f AS (SELECT conv_id, count(*) AS message_count, arg_max(line, i) FILTER (WHERE starts_with(upper(line), 'USER:')) AS last,
 concat_ws(',', {', '.join(f"CASE WHEN bool_or({any_of('lower(line)', w)}) THEN '{n}' END" for n, w in V.TOPICS)}) AS topics FROM n GROUP BY 1)
SELECT conv_id, message_count, substr(regexp_replace(replace(last, 'USER:', ''), '^\\s+|\\s+$', '', 'g'), 1, 200) AS last_user, condensed, topics FROM f JOIN d USING (conv_id)""",
)
def _(t):
    return plain(X.conversation_digest(t.conversations, "conv_id", "turn", "role", "text"))


@query(
    "k5_recent_history",
    """SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'USER: ' ELSE 'ASSISTANT: ' END || substr(text, 1, 300), chr(10) ORDER BY turn) AS history FROM
(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6 GROUP BY 1""",
)
def _(t):
    return X.recent_history(t.conversations, "conv_id", "turn", "role", "text")


def usage_sql(source: str, window: int) -> str:
    return f"""SELECT *, CASE WHEN usage_percent < 50 THEN 'safe' WHEN usage_percent < 75 THEN 'moderate' WHEN usage_percent < 90 THEN 'high' ELSE 'critical' END AS band FROM
(SELECT *, round(CAST(tokens AS DOUBLE) / {window} * 100, 2) AS usage_percent FROM (SELECT *, CASE WHEN chars = 0 THEN 0 ELSE greatest(chars // 4, 1) END AS tokens FROM ({source})))"""


@query("k6_context_usage", usage_sql("SELECT doc_id, length(text) AS chars FROM documents", 2000))
def _(t):
    return plain(X.context_usage(t.documents.select("doc_id", "text"), "text", 2000).drop("text"))


@query("k6_context_usage_per_conversation", usage_sql("SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1", 1024))
def _(t):
    return plain(X.context_usage(t.conversations, "text", 1024, ["conv_id"]))


# reports: a document followed by the titles its id selects, written in three ways
TITLES = " || ".join(
    f"CASE WHEN doc_id % {i + 2} = 0 THEN ' {s if i % 3 == 0 else s.replace(' ', '_') if i % 3 == 1 else s.replace(' ', '-').upper()}' ELSE '' END"
    for i, s in enumerate(V.REPORT_SECTIONS)
)
NO_TITLE = [f"CASE WHEN NOT {any_of('t', [s.lower(), s.lower().replace(' ', '_'), s.lower().replace(' ', '-')])} THEN '{s}' END" for s in V.REPORT_SECTIONS]


@query(
    "k7_section_completeness",
    f"""WITH r AS (SELECT doc_id, lower(text || {TITLES}) AS t FROM documents),
m AS (SELECT doc_id, list_filter([{', '.join(NO_TITLE)}], lambda x: x IS NOT NULL) AS gone FROM r)
SELECT doc_id, array_to_string(gone, ',') AS missing, 10 - len(gone) AS present, round((10 - len(gone)) / 10 * 100, 1) AS score_percent, len(gone) = 0 AS is_complete FROM m""",
)
def _(t):
    reports = t.documents.select("doc_id", F.expr(f"text || {TITLES}").alias("report"))
    return plain(X.section_completeness(reports, "report").drop("report"))


@query(
    "k8_activity_metrics",
    """WITH p AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, min(ts) AS f, count(*) FILTER (WHERE value > 1) AS c FROM events GROUP BY 1, 2)
SELECT day, CAST(sum(c) OVER (PARTITION BY day) AS BIGINT) AS calls, count(*) OVER (PARTITION BY day) AS actors,
 row_number() OVER (PARTITION BY day ORDER BY f, event_type) AS place, event_type FROM p""",
)
def _(t):
    days = t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return plain(X.activity_metrics(days, "day", "ts", "event_type", F.col("value") > 1))


ORDER_NUMERIC = ("o_orderkey", "o_custkey", "o_totalprice")
PROFILE = f"""s AS ({_stats_sql('orders', ORDER_NUMERIC)}), prof AS (SELECT "column" AS item, 'min' AS metric, min AS value FROM s UNION ALL SELECT "column", 'max', max FROM s
 UNION ALL SELECT "column", 'mean', mean FROM s UNION ALL SELECT "column", 'std', std FROM s
 UNION ALL SELECT '*', 'rows', (SELECT count(*) FROM orders) UNION ALL SELECT '*', 'columns', 6 UNION ALL SELECT '*', 'missing_cells', 0
 UNION ALL SELECT '*', 'missing_percent', 0 UNION ALL SELECT '*', 'duplicate_rows', 0)"""
QUALITY = "qual AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS item, 'zscore_outliers' AS metric, k AS value FROM (SELECT count(*) FILTER (WHERE abs(({c} - m) / nullif(s, 0)) > 3) AS k FROM orders, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM orders)) WHERE k > 0"""
    for c in ORDER_NUMERIC
) + " UNION ALL SELECT 'o_orderdate', 'high_cardinality', count(DISTINCT o_orderdate) FROM orders HAVING count(DISTINCT o_orderdate) > 50)"
CASES = "cases AS (SELECT use_case AS item, 'datasets' AS metric, count(*) AS value FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS use_case, {joined_score(words)} AS score FROM j" for name, words in V.USE_CASES
) + ") WHERE score > 0 GROUP BY 1)"
GROUPS = "grp AS (SELECT g AS item, 'columns' AS metric, count(*) AS value FROM (" + " UNION ALL ".join(
    f"SELECT '{g}' AS g FROM c WHERE {any_of('lower(' + chr(34) + 'column' + chr(34) + ')', words)}" for g, words in V.FEATURE_GROUPS
) + """ UNION ALL SELECT 'generic' FROM c WHERE dataset IN (SELECT dataset FROM c GROUP BY dataset HAVING NOT bool_or(%s))) GROUP BY 1)""" % " OR ".join(
    any_of('lower("column")', words) for _, words in V.FEATURE_GROUPS
)


@query(
    "k9_report_table",
    f"""WITH {PROFILE}, {QUALITY}, {CATALOG}, {JOINED}, {CASES}, {GROUPS}, a AS (
SELECT 'dataset_summary' AS section, item, metric, CAST(value AS DOUBLE) AS value FROM prof
UNION ALL SELECT 'data_quality', item, metric, value FROM qual
UNION ALL SELECT 'kpis', strftime({period_sql('year', 'o_orderdate')}, '%Y'), 'total_revenue', sum(o_totalprice) FROM orders GROUP BY 2
UNION ALL SELECT 'dashboard', o_orderpriority, 'revenue', sum(o_totalprice) FROM orders GROUP BY 2
UNION ALL SELECT 'use_cases', item, metric, value FROM cases WHERE item <> '{V.NO_USE_CASE}'
UNION ALL SELECT 'features', item, metric, value FROM grp)
SELECT section, item, metric, round(value, 4) AS value FROM a""",
)
def _(t):
    named = lambda df, item, metric, value: df.select(
        F.col(item).alias("item"), (F.lit(metric[1:]) if metric.startswith("=") else F.col(metric)).alias("metric"), F.col(value).alias("value")
    )
    revenue = K.total_revenue(t.orders, "o_totalprice", "o_orderdate", "year")
    cases = M.rank_use_cases(catalog(t)).filter(F.col("score") > 0).groupBy("use_case").agg(F.count(F.lit(1)).alias("n"))
    groups = M.feature_groups(catalog(t)).groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    return plain(
        X.report_table(
            {
                "dataset_summary": named(P.profile_table(t.orders), "column", "metric", "value"),
                "data_quality": named(Q.quality_report(t.orders, temporal_as_string=True), "column", "check", "affected"),
                "kpis": named(revenue.withColumn("y", F.date_format("period", "yyyy")), "y", "=total_revenue", "value"),
                "dashboard": named(
                    C.revenue_by_category(t.orders, "o_orderpriority", F.col("o_totalprice")), "o_orderpriority", "=revenue", "revenue"
                ),
                "use_cases": named(cases, "use_case", "=datasets", "n"),
                "features": named(groups, "group", "=columns", "n"),
            }
        )
    )
