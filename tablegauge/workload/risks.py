"""Training-data risks, splits, schema and drift checks."""

from pyspark.sql import functions as F

from tablegauge.operators import risks as R
from tablegauge.operators import split as X
from tablegauge.operators.quality import severity_summary
from tablegauge.workload.registry import plain, query

NONE = "CAST(NULL AS DOUBLE)"


def label_risks(labels):
    """Labels with gaps in the target, repeats, a constant, a text id and a leaky name."""
    base = labels.select(
        "doc_id",
        "quality",
        F.when(F.col("doc_id") % 11 != 0, F.col("toxic") * (1 - F.col("quality"))).alias("toxic"),
        F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("author"),
        F.lit(1).alias("version"),
        (F.col("quality") * 2).alias("final_score"),
        F.col("doc_id").alias("created_day"),
    )
    return base.unionByName(base.filter("quality = 1"))


SQL_LABELS = """WITH r0 AS (SELECT doc_id, quality, CASE WHEN doc_id % 11 <> 0 THEN toxic * (1 - quality) END AS toxic,
 'u' || doc_id AS author, 1 AS version, quality * 2 AS final_score, doc_id AS created_day FROM labels),
r AS (SELECT * FROM r0 UNION ALL SELECT * FROM r0 WHERE quality = 1)
"""
ISSUE_ROW = 'SELECT \'{check}\' AS "check", {column} AS "column", \'{severity}\' AS severity, {affected} AS affected, {pct} AS pct, {detail} AS detail, \'{fix}\' AS fix FROM {source}'


def _issue(check, column, severity, affected, pct, detail, fix, source):
    return ISSUE_ROW.format(**locals())


E1 = _issue("missing_target", "'churned'", "critical", "count(*)", NONE, "'column is not in the table'", "add target", "r")
E2 = _issue(
    "null_target", "'toxic'", "critical", "k", "round(k * 100.0 / n, 2)", "k || ' target values missing'", "drop_null_rows",
    "(SELECT count(*) - count(toxic) AS k, count(*) AS n FROM r) WHERE k > 0",
)
E3 = _issue(
    "class_imbalance", "'toxic'", "high", "k", "round(k * 1.0 / n * 100, 2)", "'rarest of ' || c || ' classes'", "balanced_class_weights",
    "(SELECT min(k) AS k, CAST(sum(k) AS BIGINT) AS n, count(*) AS c FROM (SELECT toxic, count(*) AS k FROM r WHERE toxic IS NOT NULL GROUP BY toxic)) WHERE k * 1.0 / n < 0.1 AND c <= 20",
)
E5 = _issue(
    "duplicate_records", "'ALL'", "medium", "k", "round(k * 100.0 / n, 2)", "k || ' rows repeat an earlier row'", "drop_duplicate_rows",
    "(SELECT CAST(sum(c - 1) AS BIGINT) AS k, sum(c) AS n FROM (SELECT count(*) AS c FROM r GROUP BY doc_id, quality, toxic, author, version, final_score, created_day)) WHERE k > 0",
)
E6 = _issue(
    "high_cardinality_column", "'author'", "medium", "k", NONE, "k || ' distinct values'", "target_encode or hash_encode",
    "(SELECT count(DISTINCT author) AS k FROM r) WHERE k > 50",
)
E7 = " UNION ALL ".join(
    _issue(
        "constant_column", f"'{c}'", "low", "n", NONE, "'only value: ' || v", "drop_constant_columns",
        f"(SELECT count(*) AS n, count(DISTINCT {c}) AS d, CAST(min({c}) AS VARCHAR) AS v FROM r) WHERE d = 1",
    )
    for c in ("quality", "toxic", "version", "author")
)
E8 = _issue("leakage_candidate", "'final_score'", "high", "count(*)", NONE, "'may be known only afterwards'", "verify or drop", "r")
E9 = " UNION ALL ".join(
    _issue(
        "outliers", f"'{c}'", "low", "k", "round(k * 100.0 / n, 2)", "k || ' values beyond the z limit'", "clip_iqr or log_transform",
        f"(SELECT count(*) FILTER (WHERE abs(({c} - m) / nullif(s, 0)) > 3) AS k, count(*) AS n FROM r, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM r)) WHERE k > 0",
    )
    for c in ("doc_id", "quality", "toxic", "version", "final_score", "created_day")
)
E10 = _issue("time_split", "'ALL'", "medium", "CAST(1 AS BIGINT)", NONE, "'created_day'", "temporal_split", "(SELECT count(*) FROM r)")


@query("e1_risk_missing_target", SQL_LABELS + E1)
def _(t):
    return plain(R.risk_missing_target(label_risks(t.labels), "churned"))


@query("e2_risk_null_target", SQL_LABELS + E2)
def _(t):
    return plain(R.risk_null_target(label_risks(t.labels), "toxic"))


@query("e3_risk_class_imbalance", SQL_LABELS + E3)
def _(t):
    return plain(R.risk_class_imbalance(label_risks(t.labels), "toxic"))


@query(
    "e4_class_distribution",
    "SELECT CAST(quality AS BIGINT) AS class, count(*) AS n, round(count(*) * 1.0 / (SELECT count(quality) FROM labels), 4) AS share FROM labels GROUP BY quality",
)
def _(t):
    return plain(R.class_distribution(t.labels, "quality"))


@query("e5_risk_duplicates", SQL_LABELS + E5)
def _(t):
    return plain(R.risk_duplicates(label_risks(t.labels)))


@query("e6_risk_high_cardinality", SQL_LABELS + E6)
def _(t):
    return plain(R.risk_high_cardinality(label_risks(t.labels)))


@query("e7_risk_constant", SQL_LABELS + E7)
def _(t):
    return plain(R.risk_constant(label_risks(t.labels)))


LEAK_SQL = " OR ".join(
    f"contains(c, '{w}')"
    for w in ("future_", "final_", "_result", "_outcome", "_after", "post_", "approved", "closed", "completed")
)
TIME_SQL = " OR ".join(f"contains(c, '{w}')" for w in ("date", "time", "created", "day", "month"))
# a catalog of column names: the names a document holds, with a suffix taken from its source
NAMES_SQL = """WITH names AS (SELECT doc_id AS dataset, lower(w) || CASE WHEN length(w) = 7 THEN '_result' WHEN length(w) = 6 THEN '_at_time' ELSE '' END AS c
 FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]+')) AS w FROM documents))
"""


def name_catalog(documents):
    """One row per word of each document, used as a wide catalog of column names."""
    word = F.col("w")
    suffix = F.when(F.length(word) == 7, "_result").when(F.length(word) == 6, "_at_time").otherwise("")
    return documents.select(
        F.col("doc_id").alias("dataset"), F.explode(F.split("text", "[ \n]+")).alias("w")
    ).select("dataset", F.concat(F.lower(word), suffix).alias("column"))


@query("e8_risk_leakage_names", NAMES_SQL + f"SELECT dataset, count(*) AS n FROM names WHERE {LEAK_SQL} GROUP BY dataset")
def _(t):
    return R.leakage_names(name_catalog(t.documents)).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("e9_risk_outliers", SQL_LABELS + E9)
def _(t):
    return plain(R.risk_outliers(label_risks(t.labels)))


@query("e10_risk_time_split", NAMES_SQL + f"SELECT dataset, count(*) AS n FROM names WHERE {TIME_SQL} GROUP BY dataset")
def _(t):
    return R.time_names(name_catalog(t.documents)).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


REPORT_SQL = SQL_LABELS + ", " + ", ".join(
    f"p{i} AS ({sql})" for i, sql in enumerate([E2, E3, E5, E6, E7, E8, E9, E10])
) + " , report AS (" + " UNION ALL ".join(f"SELECT *, CAST({i + 1} AS BIGINT) AS place FROM p{i}" for i in range(8)) + ")"


@query("e11_ml_risk_report", REPORT_SQL + " SELECT * FROM report")
def _(t):
    return plain(R.ml_risk_report(label_risks(t.labels), "toxic"))


@query("e11_severity_summary", REPORT_SQL + " SELECT severity, count(*) AS issues FROM report GROUP BY severity")
def _(t):
    return severity_summary(R.ml_risk_report(label_risks(t.labels), "toxic"))


@query(
    "e11_verdict",
    REPORT_SQL
    + """ SELECT count(*) AS issues, CASE WHEN count(*) FILTER (WHERE severity = 'critical') > 0 THEN 'critical: fix first'
 WHEN count(*) FILTER (WHERE severity = 'high') > 0 THEN 'high: review first' ELSE 'low or medium only: proceed with care' END AS verdict FROM report""",
)
def _(t):
    return R.risk_verdict(R.ml_risk_report(label_risks(t.labels), "toxic"))


@query(
    "e12_temporal_split",
    """SELECT o_orderkey, CASE WHEN o_orderdate <= (SELECT quantile_disc(o_orderdate, 0.8) FROM orders) THEN 'train' ELSE 'test' END AS split FROM orders""",
)
def _(t):
    return X.temporal_split(t.orders, "o_orderdate").select("o_orderkey", "split")


@query(
    "e13_stratified_split",
    """SELECT doc_id, toxic, CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM
(SELECT doc_id, CAST(toxic AS BIGINT) AS toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r,
 count(*) OVER (PARTITION BY toxic) AS n FROM labels)""",
)
def _(t):
    return plain(X.stratified_split(t.labels, "toxic", "doc_id").select("doc_id", "toxic", "split"))


@query(
    "e14_random_split",
    """SELECT o_orderkey, CASE WHEN CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM orders""",
)
def _(t):
    return X.random_split(t.orders, "o_orderkey").select("o_orderkey", "split")


@query(
    "e15_time_series_folds",
    """WITH c AS (SELECT quantile_disc(o_orderdate, 0.25) AS c1, quantile_disc(o_orderdate, 0.5) AS c2, quantile_disc(o_orderdate, 0.75) AS c3 FROM orders),
p AS (SELECT o_orderkey, CASE WHEN o_orderdate > c3 THEN 3 WHEN o_orderdate > c2 THEN 2 WHEN o_orderdate > c1 THEN 1 ELSE 0 END AS part FROM orders, c),
f AS (SELECT unnest([1, 2, 3]) AS fold)
SELECT o_orderkey, CAST(fold AS BIGINT) AS fold, CASE WHEN part < fold THEN 'train' ELSE 'test' END AS role FROM p JOIN f ON fold >= part""",
)
def _(t):
    return plain(X.time_series_folds(t.orders, "o_orderdate").select("o_orderkey", "fold", "role"))


@query(
    "e16_balanced_class_weights",
    """WITH c AS (SELECT toxic, count(*) AS k FROM labels GROUP BY toxic)
SELECT doc_id, round((SELECT sum(k) FROM c) * 1.0 / ((SELECT count(*) FROM c) * k), 4) AS class_weight FROM labels JOIN c USING (toxic)""",
)
def _(t):
    return plain(R.balanced_class_weights(t.labels, "toxic").select("doc_id", "class_weight"))


# two versions of a catalog: the words of each language in the earlier and the later half of
# the sources, typed by the length of the longest document that holds the word
VERSION = "SELECT lang AS dataset, c AS \"column\", CASE WHEN max(n_chars) > 2000 THEN 'string' ELSE 'int' END AS dtype FROM w WHERE {} GROUP BY 1, 2"


@query(
    "e17_schema_check",
    f"""WITH w AS (SELECT lang, source, n_chars, unnest(regexp_split_to_array(text, '[ \\n]+')) AS c FROM documents),
a AS ({VERSION.format("source < 'src19'")}), b AS ({VERSION.format("source >= 'src19'")}),
j AS (SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(a."column", b."column") AS "column", a.dtype AS dtype, b.dtype AS expected_dtype
 FROM a FULL JOIN b ON a.dataset = b.dataset AND a."column" = b."column"),
f AS (SELECT dataset, CASE WHEN dtype IS NULL THEN 'missing' WHEN expected_dtype IS NULL THEN 'extra' WHEN dtype <> expected_dtype THEN 'changed' END AS finding FROM j)
SELECT dataset, finding, count(*) AS n FROM f WHERE finding IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    words = t.documents.select(
        F.col("lang").alias("dataset"), "source", "n_chars", F.explode(F.split("text", "[ \n]+")).alias("column")
    )
    version = lambda side: (
        words.filter(side)
        .groupBy("dataset", "column")
        .agg(F.when(F.max("n_chars") > 2000, "string").otherwise("int").alias("dtype"))
    )
    found = R.schema_check(version("source < 'src19'"), version("source >= 'src19'"), ("dataset", "column"))
    return found.groupBy("dataset", "finding").agg(F.count(F.lit(1)).alias("n"))


def _drift(c: str, numeric: bool) -> str:
    label = (
        " + ".join(f"CAST({c} > (SELECT quantile_cont({c}, {i / 10}) FROM b) AS INT)" for i in range(1, 10)) if numeric else c
    )
    mean = (
        f"round(((SELECT avg({c}) FROM a) - (SELECT avg({c}) FROM b)) / (SELECT stddev_samp({c}) FROM b), 4)" if numeric else NONE
    )
    return f"""SELECT '{c}' AS "column", CAST(0 AS DOUBLE) AS null_rate_before, CAST(0 AS DOUBLE) AS null_rate_after, CAST(0 AS DOUBLE) AS null_rate_change, {mean} AS mean_shift,
 round(psi, 4) AS psi, psi > 0.2 AS drift FROM (SELECT sum((q - p) * ln(q / p)) AS psi FROM (
 SELECT greatest(count(*) FILTER (WHERE s = 0) * 1.0 / (SELECT count(*) FROM b), 0.0001) AS p,
  greatest(count(*) FILTER (WHERE s = 1) * 1.0 / (SELECT count(*) FROM a), 0.0001) AS q
 FROM (SELECT 0 AS s, {label} AS l FROM b UNION ALL SELECT 1, {label} FROM a) GROUP BY l))"""


@query(
    "e18_drift_report",
    "WITH b AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16'), a AS (SELECT * REPLACE (value * 1.5 AS value) FROM events WHERE ts >= TIMESTAMP '2024-01-16') "
    + " UNION ALL ".join(f"SELECT * FROM ({_drift(c, n)})" for c, n in (("value", True), ("user_id", True), ("event_type", False))),
)
def _(t):
    columns = ["value", "user_id", "event_type"]
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    later = t.events.filter(F.col("ts") >= half).withColumn("value", F.col("value") * 1.5)
    return plain(R.drift_report(t.events.filter(F.col("ts") < half), later, columns))
