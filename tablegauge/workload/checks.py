"""Quality checks."""

from tablegauge.operators import quality as Q
from tablegauge.workload.registry import plain, query
from tablegauge.workload.samples import DIRTY_COLUMNS, DIRTY_NUMERIC, DIRTY_TEXT, SQL_DIRTY, dirty_lineitem

NO_PCT = "CAST(NULL AS DOUBLE) AS pct"

C1 = f"""c1 AS (SELECT 'missing_values' AS "check", "column",
 CASE WHEN pct > 30 THEN 'critical' WHEN pct > 10 THEN 'high' ELSE 'medium' END AS severity, affected, pct,
 affected || ' of ' || n || ' cells missing' AS detail, 'impute or drop_null_rows' AS fix
 FROM (SELECT *, round(affected * 100.0 / n, 2) AS pct FROM ({
    " UNION ALL ".join(f"SELECT '{c}' AS " + '"column"' + f", count(*) - count({c}) AS affected, count(*) AS n FROM dirty" for c in DIRTY_COLUMNS)
}) WHERE affected > 0))"""
C2 = f"""c2 AS (SELECT 'duplicate_rows' AS "check", 'ALL' AS "column", 'medium' AS severity, affected,
 round(affected * 100.0 / n, 2) AS pct, affected || ' rows repeat an earlier row' AS detail, 'drop_duplicate_rows' AS fix
 FROM (SELECT CAST(sum(k - 1) AS BIGINT) AS affected, sum(k) AS n FROM (SELECT count(*) AS k FROM dirty GROUP BY {', '.join(DIRTY_COLUMNS)}))
 WHERE affected > 0)"""
C3 = """c3 AS (SELECT 'constant_column' AS "check", "column", 'low' AS severity, n AS affected, CAST(NULL AS DOUBLE) AS pct,
 'only value: ' || coalesce(v, '(null)') AS detail, 'drop_constant_columns' AS fix FROM (%s) WHERE d <= 1)""" % " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS d, count(*) AS n, CAST(min({c}) AS VARCHAR) AS v FROM dirty"""
    for c in DIRTY_COLUMNS
)
C4 = """c4 AS (SELECT 'high_cardinality' AS "check", "column", 'medium' AS severity, d AS affected, CAST(NULL AS DOUBLE) AS pct,
 d || ' distinct values' AS detail, 'target_encode or hash_encode' AS fix FROM (%s) WHERE d > 50)""" % " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS d FROM dirty""" for c in DIRTY_TEXT
)
C5 = """c5 AS (SELECT 'negative_values' AS "check", "column", 'high' AS severity, k AS affected, round(k * 100.0 / n, 2) AS pct,
 k || ' values below zero' AS detail, 'review source' AS fix FROM (%s) WHERE k > 0)""" % " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} < 0) AS k, count(*) AS n FROM dirty"""
    for c in ("quantity", "discount", "unit_price")
)
C6 = """c6 AS (SELECT 'zscore_outliers' AS "check", "column", 'low' AS severity, k AS affected, round(k * 100.0 / n, 2) AS pct,
 k || ' values beyond the z limit' AS detail, 'clip_iqr or log_transform' AS fix FROM (%s) WHERE k > 0)""" % " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE abs(({c} - m) / nullif(s, 0)) > 3) AS k, count(*) AS n
 FROM dirty, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM dirty)"""
    for c in DIRTY_NUMERIC
)
REPORT = f"WITH {SQL_DIRTY}, {C1}, {C2}, {C3}, {C4}, {C5}, {C6}, report AS (" + " UNION ALL ".join(
    f"SELECT * FROM c{i}" for i in range(1, 7)
) + ")"


def _one(part: str, name: str) -> str:
    return f"WITH {SQL_DIRTY}, {part} SELECT * FROM {name}"


@query("c1_check_missing", _one(C1, "c1"))
def _(t):
    return plain(Q.check_missing(dirty_lineitem(t.lineitem)))


@query("c2_check_duplicates", _one(C2, "c2"))
def _(t):
    return plain(Q.check_duplicates(dirty_lineitem(t.lineitem)))


@query("c3_check_constant", _one(C3, "c3"))
def _(t):
    return plain(Q.check_constant(dirty_lineitem(t.lineitem)))


@query("c4_check_high_cardinality", _one(C4, "c4"))
def _(t):
    return plain(Q.check_high_cardinality(dirty_lineitem(t.lineitem)))


@query("c5_check_negative_in_positive", _one(C5, "c5"))
def _(t):
    return plain(Q.check_negative_in_positive(dirty_lineitem(t.lineitem)))


@query("c6_check_zscore_outliers", _one(C6, "c6"))
def _(t):
    return plain(Q.check_zscore_outliers(dirty_lineitem(t.lineitem)))


@query("c7_severity_summary", REPORT + " SELECT severity, count(*) AS issues FROM report GROUP BY severity")
def _(t):
    return Q.severity_summary(Q.quality_report(dirty_lineitem(t.lineitem)))


@query(
    "c8_overall_verdict",
    REPORT
    + """ SELECT count(*) AS issues, CASE WHEN count(*) FILTER (WHERE severity = 'critical') > 0 THEN 'critical: fix first'
 WHEN count(*) FILTER (WHERE severity = 'high') > 0 THEN 'high: review first'
 WHEN count(*) > 0 THEN 'low or medium only: proceed with care' ELSE 'none' END AS verdict FROM report""",
)
def _(t):
    return Q.overall_verdict(Q.quality_report(dirty_lineitem(t.lineitem)))


@query("c9_quality_report", REPORT + " SELECT * FROM report")
def _(t):
    return plain(Q.quality_report(dirty_lineitem(t.lineitem)))
