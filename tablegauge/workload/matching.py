"""Column matching over a catalog of datasets, goals and contexts."""

from pyspark.sql import functions as F

from tablegauge.functions import fixed_values as V
from tablegauge.operators import matching as M
from tablegauge.workload.registry import plain, query

# a catalog with one dataset per customer: every order contributes one column name
NAMES = (
    "order_id", "customer_id", "total_spend", "event_type", "created_at", "is_flagged", "Unit_Price", "status",
    "payment_method", "color", "note", "weight", "user_id", "subscription_value", "quantity", "page_view",
    "churn", "day_of_visit", "revenue", "transaction_id", "timestamp", "amount", "segment", "width",
)
DOMAINS = ("ecommerce retail", "SaaS", "fin", "", "event", "healthcare provider", "logistics", "Events and fintech")
NAME_EXPR = "CASE (o_orderkey * 7 + o_custkey) % 24 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END"
DOMAIN_EXPR = "CASE {} % 8 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(DOMAINS)) + " END"
CATALOG = f'c AS (SELECT o_custkey AS dataset, {NAME_EXPR} AS "column", {DOMAIN_EXPR.format("o_custkey")} AS domain FROM orders)'


def catalog(t):
    return t.orders.select(
        F.col("o_custkey").alias("dataset"), F.expr(NAME_EXPR).alias("column"), F.expr(DOMAIN_EXPR.format("o_custkey")).alias("domain")
    )


def any_of(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def joined_score(words) -> str:
    return " + ".join(f"CAST(contains(j, '{w}') AS INT)" for w in words)


JOINED = """j AS (SELECT dataset, string_agg(DISTINCT lower("column"), ' ') AS j FROM c GROUP BY dataset)"""


@query(
    "j1_rank_use_cases",
    f"WITH {CATALOG}, {JOINED}, s AS ("
    + " UNION ALL ".join(
        f"SELECT dataset, {i} AS i, '{name}' AS use_case, {joined_score(words)} AS score FROM j"
        for i, (name, words) in enumerate(V.USE_CASES)
    )
    + f"""), k AS (SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, i) AS place, use_case, CAST(score AS BIGINT) AS score FROM s WHERE score > 0)
SELECT * FROM k UNION ALL SELECT dataset, 1, '{V.NO_USE_CASE}', 0 FROM j WHERE dataset NOT IN (SELECT dataset FROM k)""",
)
def _(t):
    return plain(M.rank_use_cases(catalog(t)))


def _kpi_sql(domain: str) -> str:
    return " UNION ALL ".join(
        f"SELECT dataset, '{domain}' AS library, '{name}' AS kpi, CASE WHEN {any_of('j', words)} THEN 'matched' ELSE 'partial' END AS match FROM j"
        for name, words in V.KPI_CATALOG[domain]
    )


@query("j2_match_kpi_columns", f"WITH {CATALOG}, {JOINED} " + " UNION ALL ".join(_kpi_sql(d) for d in V.KPI_CATALOG))
def _(t):
    parts = [M.match_kpi_columns(catalog(t), d).withColumn("library", F.lit(d)) for d in V.KPI_CATALOG]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _domain_sql(keys, text: str) -> str:
    tests = [f"WHEN contains(lower({text}), '{k}') OR contains('{k}', lower({text})) THEN '{k}'" for k in keys]
    return f"CASE {' '.join(tests)} END"


@query(
    "j3_match_domain",
    f"""WITH d AS (SELECT c_custkey, {DOMAIN_EXPR.format('c_custkey')} AS domain FROM customer)
SELECT c_custkey, {_domain_sql(V.KPI_CATALOG, 'domain')} AS catalog, {_domain_sql(V.SUGGESTED_KPIS, 'domain')} AS suggested FROM d""",
)
def _(t):
    d = t.customer.select("c_custkey", F.expr(DOMAIN_EXPR.format("c_custkey")).alias("domain"))
    return d.select(
        "c_custkey",
        M.match_domain(F.col("domain")).alias("catalog"),
        M.match_domain(F.col("domain"), "suggested").alias("suggested"),
    )


def _suggest_sql() -> str:
    rows, place = [], 0
    for key, names in V.SUGGESTED_KPIS.items():
        for name in names:
            rows.append(f"SELECT dataset, {place} AS o, '{name}' AS kpi FROM d WHERE lib = '{key}'")
            place += 1
    for name, words in V.COLUMN_KPIS:
        listed = ", ".join(f"'{w}'" for w in words)
        rows.append(f"SELECT DISTINCT dataset, {place} AS o, '{name}' AS kpi FROM c WHERE lower(\"column\") IN ({listed})")
        place += 1
    return " UNION ALL ".join(rows)


@query(
    "j4_suggest_column_kpis",
    f"""WITH {CATALOG}, d AS (SELECT dataset, {_domain_sql(V.SUGGESTED_KPIS, 'max(domain)')} AS lib FROM c GROUP BY dataset), r AS ({_suggest_sql()}),
u AS (SELECT dataset, kpi, min(o) AS o FROM r GROUP BY 1, 2)
SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY o) AS place, kpi FROM u""",
)
def _(t):
    return plain(M.suggest_column_kpis(catalog(t)))


def _groups_sql(rules) -> str:
    parts = " UNION ALL ".join(
        f"SELECT dataset, '{g}' AS \"group\", \"column\" FROM c WHERE {any_of('lower(\"column\")', words)}" for g, words in rules
    )
    return f"""m AS ({parts}), a AS (SELECT * FROM m UNION ALL SELECT dataset, 'generic', "column" FROM c WHERE dataset NOT IN (SELECT dataset FROM m))"""


@query("j5_feature_groups", f'WITH {CATALOG}, {_groups_sql(V.FEATURE_GROUPS)} SELECT dataset, "group", "column" FROM a')
def _(t):
    return M.feature_groups(catalog(t))


@query("j5_feature_groups_wide", f'WITH {CATALOG}, {_groups_sql(V.FEATURE_GROUPS_WIDE)} SELECT "group", count(*) AS n FROM a GROUP BY 1')
def _(t):
    return M.feature_groups(catalog(t), wide=True).groupBy("group").agg(F.count(F.lit(1)).alias("n"))


# goals: a customer's market segment and one phrase
PHRASES = (
    "detect fraud", "forecast next month", "how much revenue", "segment users", "find unusual spikes",
    "recommend items", "rank results", "plain goal", "false alarm cost", "prioritize a costly miss", "precision of alerts",
)
GOAL_EXPR = "concat(c_mktsegment, ': ', CASE c_custkey % 11 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + " END)"


@query(
    "j6_recommend_problem_type",
    f"""WITH g AS (SELECT c_custkey, lower({GOAL_EXPR}) AS t FROM customer)
SELECT c_custkey, CASE {' '.join(f"WHEN {any_of('t', words)} THEN '{p}'" for p, words in V.PROBLEM_TYPES)} ELSE 'classification' END AS problem_type FROM g
UNION ALL SELECT -doc_id - 1, CASE {' '.join(f"WHEN {any_of('lower(text)', words)} THEN '{p}'" for p, words in V.PROBLEM_TYPES)} ELSE 'classification' END FROM documents""",
)
def _(t):
    goals = t.customer.select("c_custkey", F.expr(GOAL_EXPR).alias("goal"))
    texts = t.documents.select((-F.col("doc_id") - 1).alias("c_custkey"), F.col("text").alias("goal"))
    both = goals.unionByName(texts)
    return both.select("c_custkey", M.recommend_problem_type(F.col("goal")).alias("problem_type"))


@query(
    "j7_metric_advice_flags",
    f"""WITH g AS (SELECT c_custkey, lower({GOAL_EXPR}) AS t FROM customer)
SELECT c_custkey, {any_of('t', V.RECALL_WORDS)} AS favour_recall, {any_of('t', V.PRECISION_WORDS)} AS favour_precision FROM g""",
)
def _(t):
    recall, precision = M.metric_advice_flags(F.expr(GOAL_EXPR))
    return t.customer.select("c_custkey", recall.alias("favour_recall"), precision.alias("favour_precision"))
