"""Anomaly detection."""

from tablegauge.operators import anomaly as A
from tablegauge.workload.registry import plain, query

FIT = """WITH fit AS (SELECT avg(value) AS m, stddev_pop(value) AS sp, stddev_samp(value) AS ss, count(value) AS n,
 quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
f AS (SELECT event_id, value, (value - m) / nullif(sp, 0) AS z, abs((value - m) / nullif(sp, 0)) > 3 AS bz,
 value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS bi FROM events, fit)
"""
SHOW = "event_id, round(value, 4) AS value, round(z, 4) AS z"


@query("d1_anomalies_zscore", FIT + f"SELECT {SHOW}, bz AS by_zscore, false AS by_iqr FROM f WHERE bz")
def _(t):
    return plain(A.anomalies(t.events, "value", ["event_id"], "zscore"))


@query("d2_anomalies_iqr", FIT + f"SELECT {SHOW}, false AS by_zscore, bi AS by_iqr FROM f WHERE bi")
def _(t):
    return plain(A.anomalies(t.events, "value", ["event_id"], "iqr"))


@query("d3_anomalies_both", FIT + f"SELECT {SHOW}, bz AS by_zscore, bi AS by_iqr FROM f WHERE bz OR bi")
def _(t):
    return plain(A.anomalies(t.events, "value", ["event_id"], "both"))


@query(
    "d4_anomaly_thresholds",
    FIT
    + """SELECT 'zscore' AS method, (SELECT count(*) FROM f WHERE bz) AS anomalies, round(m - 3 * ss, 4) AS lower,
 round(m + 3 * ss, 4) AS upper, CAST(NULL AS DOUBLE) AS q1, CAST(NULL AS DOUBLE) AS q3, CAST(NULL AS DOUBLE) AS iqr FROM fit
UNION ALL SELECT 'iqr', (SELECT count(*) FROM f WHERE bi), round(q1 - 1.5 * (q3 - q1), 4), round(q3 + 1.5 * (q3 - q1), 4),
 round(q1, 4), round(q3, 4), round(q3 - q1, 4) FROM fit""",
)
def _(t):
    return plain(A.anomaly_thresholds(t.events, "value"))


@query(
    "d5_anomaly_summary",
    FIT
    + """SELECT total, percent, CASE WHEN total = 0 THEN 'none' WHEN percent < 1 THEN 'low'
 WHEN percent < 5 THEN 'moderate' ELSE 'high' END AS rate FROM
 (SELECT count(*) FILTER (WHERE bz OR bi) AS total, round(count(*) FILTER (WHERE bz OR bi) * 100.0 / count(value), 2) AS percent FROM f)""",
)
def _(t):
    return A.anomaly_summary(t.events, "value")


@query(
    "d6_anomaly_sample",
    FIT + f"SELECT {SHOW}, bz AS by_zscore, bi AS by_iqr FROM f WHERE bz OR bi ORDER BY event_id LIMIT 20",
)
def _(t):
    return plain(A.anomaly_sample(t.events, "value", ["event_id"]))


@query(
    "d7_anomalies_grouped",
    """WITH fit AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sp, quantile_cont(value, 0.25) AS q1,
 quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type),
f AS (SELECT event_type, event_id, value, (value - m) / nullif(sp, 0) AS z, abs((value - m) / nullif(sp, 0)) > 3 AS bz,
 value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS bi FROM events JOIN fit USING (event_type))
SELECT event_type, event_id, round(value, 4) AS value, round(z, 4) AS z, bz AS by_zscore, bi AS by_iqr FROM f WHERE bz OR bi""",
)
def _(t):
    return plain(A.anomalies_grouped(t.events, "value", ["event_type"], ["event_id"]))
