"""Evaluation metrics."""

from pyspark.sql import functions as F

from tablegauge.operators import evaluation as E
from tablegauge.operators import kpi as K
from tablegauge.plans.joins import join_null_safe
from tablegauge.workload.registry import plain, query

# predictions: the score of a labelled document grows with its length
SCORED = """p AS (SELECT doc_id, toxic, round(least(n_chars, 8000) / 8000, 3) AS score, CASE WHEN n_chars > 2400 THEN 1 ELSE 0 END AS predicted
 FROM labels JOIN documents USING (doc_id))"""


def scored(t):
    docs = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return docs.select(
        "doc_id", "toxic", F.round(F.least("n_chars", F.lit(8000)) / 8000, 3).alias("score"),
        F.when(F.col("n_chars") > 2400, 1).otherwise(0).alias("predicted"),
    )


@query(
    "m1_confusion_counts",
    f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (WHERE toxic = 1 AND predicted = 1) AS tp, count(*) FILTER (WHERE toxic = 0 AND predicted = 1) AS fp,
 count(*) FILTER (WHERE toxic = 1 AND predicted = 0) AS fn, count(*) FILTER (WHERE toxic = 0 AND predicted = 0) AS tn FROM p)
SELECT *, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1,
 round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, round(fp / nullif(fp + tn, 0), 4) AS false_positive_rate FROM c""",
)
def _(t):
    return plain(E.confusion(scored(t), "toxic", "predicted"))


@query(
    "m2_roc_auc",
    f"""WITH {SCORED} SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 4) AS roc_auc
FROM p a JOIN p b ON a.toxic = 1 AND b.toxic = 0""",
)
def _(t):
    return plain(E.roc_auc(scored(t), "toxic", "score"))


@query(
    "m3_pr_auc",
    f"""WITH {SCORED}, s AS (SELECT score, sum(toxic) AS pos, count(*) AS n FROM p GROUP BY 1),
c AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) / sum(n) OVER (ORDER BY score DESC) AS prec FROM s)
SELECT round(sum(pos * prec) / sum(pos), 4) AS pr_auc FROM c""",
)
def _(t):
    return plain(E.pr_auc(scored(t), "toxic", "score"))


@query(
    "m4_regression_metrics",
    """WITH p AS (SELECT p_retailprice AS a, avg(p_retailprice) OVER (PARTITION BY p_brand, p_type) AS f FROM part)
SELECT round(sqrt(avg((a - f) * (a - f))), 4) AS rmse, round(avg(abs(a - f)), 4) AS mae, round(1 - avg((a - f) * (a - f)) / var_pop(a), 4) AS r2,
 round(avg(abs((a - f) / a)) * 100, 4) AS mape, round(quantile_cont(abs(a - f), 0.5), 4) AS median_ae FROM p""",
)
def _(t):
    means = t.part.groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("guess"))
    return plain(E.regression_metrics(join_null_safe(t.part, means, ["p_brand", "p_type"]), "p_retailprice", "guess"))


DAILY = """s AS (SELECT date_trunc('day', o_orderdate) AS period, sum(o_totalprice) AS value FROM orders GROUP BY 1),
n AS (SELECT *, lag(value, 7) OVER (ORDER BY period) AS naive FROM s)"""


@query(
    "m5_forecast_metrics",
    f"""WITH {DAILY} SELECT round(avg(2 * abs(naive - value) / (abs(value) + abs(naive))) * 100, 4) AS smape, round(avg(naive - value), 4) AS bias,
 round(avg(CASE WHEN value BETWEEN naive * 0.7 AND naive * 1.3 THEN 1.0 ELSE 0.0 END), 4) AS coverage FROM n WHERE naive IS NOT NULL""",
)
def _(t):
    naive = E.naive_baseline(K.total_revenue(t.orders, "o_totalprice", "o_orderdate"), lag=7)
    bands = naive.withColumns({"lo": F.col("naive") * 0.7, "hi": F.col("naive") * 1.3})
    return plain(E.forecast_metrics(bands, "value", "naive", "lo", "hi"))


@query(
    "m5_naive_baseline",
    f"WITH {DAILY} SELECT strftime(period, '%Y-%m-%d %H:%M:%S') AS period, round(value, 4) AS value, round(naive, 4) AS naive FROM n",
)
def _(t):
    return plain(E.naive_baseline(K.total_revenue(t.orders, "o_totalprice", "o_orderdate"), lag=7))


VECTORS = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query(
    "m6_silhouette",
    f"""WITH {VECTORS}, sz AS (SELECT label, count(*) AS n FROM v GROUP BY 1),
d AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(list_distance(a.e, b.e) ** 2) AS s, count(*) AS n FROM v a JOIN v b ON true GROUP BY ALL),
m AS (SELECT vec_id, max(CASE WHEN la = lb THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN la <> lb THEN s / n END) AS b FROM d GROUP BY 1)
SELECT round(avg((b - a) / greatest(a, b)), 4) AS silhouette FROM m""",
)
def _(t):
    return plain(E.silhouette(t.embeddings, "embedding", "label"))


@query(
    "m7_cluster_metrics",
    f"""WITH {VECTORS}, x AS (SELECT vec_id, label, generate_subscripts(e, 1) AS pos, unnest(e) AS x FROM v),
c AS (SELECT label, pos, avg(x) AS m, count(*) AS n FROM x GROUP BY 1, 2), g AS (SELECT pos, avg(x) AS m FROM x GROUP BY 1),
d AS (SELECT vec_id, x.label, sum((x.x - c.m) ** 2) AS d2 FROM x JOIN c USING (label, pos) GROUP BY 1, 2),
w AS (SELECT label, sum(d2) AS w, avg(sqrt(d2)) AS s, count(*) AS n FROM d GROUP BY 1),
b AS (SELECT sum(c.n * (c.m - g.m) ** 2) AS b FROM c JOIN g USING (pos)),
cc AS (SELECT p.label AS l1, q.label AS l2, sqrt(sum((p.m - q.m) ** 2)) AS dist FROM c p JOIN c q ON p.pos = q.pos AND p.label <> q.label GROUP BY 1, 2),
r AS (SELECT l1, max((w1.s + w2.s) / dist) AS r FROM cc JOIN w w1 ON w1.label = l1 JOIN w w2 ON w2.label = l2 GROUP BY 1)
SELECT round((SELECT sum(w) FROM w), 4) AS inertia, round((SELECT b FROM b) / ((SELECT count(*) FROM w) - 1) / ((SELECT sum(w) FROM w) / ((SELECT sum(n) FROM w) - (SELECT count(*) FROM w))), 4) AS calinski_harabasz,
 round((SELECT avg(r) FROM r), 4) AS davies_bouldin""",
)
def _(t):
    return plain(E.cluster_metrics(t.embeddings, "embedding", "label"))


# recommendations: a customer's bought parts, scored by quantity; returned parts are the relevant ones
RECS = """p AS (SELECT o_custkey AS u, l_partkey AS i, sum(l_quantity) AS score, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS rel
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, i) AS place FROM p)"""


def recs(t):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy(F.col("o_custkey").alias("u"), F.col("l_partkey").alias("i")).agg(
        F.sum("l_quantity").alias("score"), F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("rel")
    )


RANKED = f"""{RECS}, a AS (SELECT u, sum(rel) AS r FROM p GROUP BY 1 HAVING sum(rel) > 0),
h AS (SELECT u, sum(rel) AS h, sum(rel / log2(place + 1)) AS dcg FROM k WHERE place <= 10 GROUP BY 1),
z AS (SELECT u, sum(1 / log2(g + 1)) AS idcg FROM (SELECT u, unnest(range(1, CAST(least(r, 10) AS BIGINT) + 1)) AS g FROM a) GROUP BY 1)"""


@query(
    "m8_ranking_at_k",
    f"""WITH {RANKED} SELECT round(avg(h / 10), 4) AS precision_at_k, round(avg(h / r), 4) AS recall_at_k, round(avg(CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END), 4) AS hit_rate,
 round(avg(dcg / idcg), 4) AS ndcg_at_k, round((SELECT count(DISTINCT i) FROM k WHERE place <= 10) / (SELECT count(DISTINCT i) FROM p), 4) AS coverage FROM h JOIN a USING (u) JOIN z USING (u)""",
)
def _(t):
    return plain(E.ranking_at_k(recs(t), "u", "i", "score", "rel", 10))


@query(
    "m9_mrr_map",
    f"""WITH {RECS}, c AS (SELECT *, sum(rel) OVER (PARTITION BY u ORDER BY place) AS got FROM k),
x AS (SELECT u, max(1 / place) AS rr, avg(got / place) AS ap FROM c WHERE rel = 1 GROUP BY 1) SELECT round(avg(rr), 4) AS mrr, round(avg(ap), 4) AS map FROM x""",
)
def _(t):
    return plain(E.mrr_map(recs(t), "u", "i", "score", "rel"))


@query(
    "m9_err",
    f"""WITH {RECS}, c AS (SELECT u, place, rel * 0.5 AS r, coalesce(exp(sum(ln(1 - rel * 0.5)) OVER (PARTITION BY u ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS lf FROM k WHERE place <= 10)
SELECT round(avg(e), 4) AS err FROM (SELECT u, sum(lf * r / place) AS e FROM c GROUP BY 1)""",
)
def _(t):
    return plain(E.expected_reciprocal_rank(recs(t), "u", "i", "score", "rel", 10))


@query(
    "m10_diversity",
    f"""WITH {RECS} SELECT round(avg(n), 4) AS diversity FROM (SELECT u, count(DISTINCT p_type) AS n FROM k JOIN part ON i = p_partkey WHERE place <= 10 GROUP BY 1)""",
)
def _(t):
    typed = recs(t).join(t.part.select(F.col("p_partkey").alias("i"), "p_type"), "i")
    return plain(E.list_diversity(typed, "u", "i", "score", "p_type", 10))
