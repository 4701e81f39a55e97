"""Known facts of the three sample files; set TABLEGAUGE_SAMPLES to their folder to run these."""

import os

import pytest

from tablegauge.operators import anomaly, matching, profile, quality, risks
from tablegauge.sources.schema import columns_table
from tablegauge.sources.tables import read_table

FOLDER = os.environ.get("TABLEGAUGE_SAMPLES", "")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="TABLEGAUGE_SAMPLES is not set")


@pytest.fixture(scope="module")
def tables(spark):
    return {n: read_table(spark, f"{n}_sample.csv", FOLDER) for n in ("events", "transactions", "customers")}


def issues(df, **kw):
    return sorted((r["check"], r["column"], r["severity"]) for r in df.collect())


def test_shapes_and_missing(tables):
    got = {n: tuple(profile.table_shape(df).first()) for n, df in tables.items()}
    assert got == {"events": (40, 9), "transactions": (40, 9), "customers": (33, 14)}
    assert tuple(profile.missing_summary(tables["events"]).first()) == (22, 6.11)
    assert profile.duplicate_row_count(tables["events"]).first()[0] == 0


def test_amount_statistics(tables):
    e = profile.column_summary(tables["events"], "amount").first()
    assert (e["min"], e["max"], e["mean"], e["std"], e["median"], e["count"]) == (18.0, 999.99, 185.46, 236.4183, 90.75, 18)
    t = profile.column_summary(tables["transactions"], "amount").first()
    assert (t["mean"], t["std"], t["median"]) == (1465.3615, 3035.2475, 209.995)
    limits = {r["method"]: r for r in anomaly.anomaly_thresholds(tables["transactions"], "amount").collect()}
    assert limits["iqr"]["anomalies"] == 7 and limits["zscore"]["anomalies"] == 1
    assert (limits["iqr"]["lower"], limits["iqr"]["upper"]) == pytest.approx((-854.375, 1592.625))
    assert limits["zscore"]["upper"] == pytest.approx(10571.1041, abs=1e-4)
    e = {r["method"]: r for r in anomaly.anomaly_thresholds(tables["events"], "amount").collect()}
    assert (e["iqr"]["lower"], e["iqr"]["upper"], e["iqr"]["anomalies"]) == pytest.approx((-162.28125, 425.66875, 2))


def test_quality(tables):
    assert issues(quality.quality_report(tables["events"], True)) == [
        ("missing_values", "amount", "critical"), ("zscore_outliers", "amount", "low")]
    assert issues(quality.quality_report(tables["transactions"], True)) == [("zscore_outliers", "amount", "low")]
    assert issues(quality.quality_report(tables["customers"], True)) == [
        ("zscore_outliers", "total_orders", "low"), ("zscore_outliers", "total_spend", "low")]


def test_risks(tables):
    found = {n: risks.ml_risk_report(tables[n], target, True) for n, target in (
        ("events", "status"), ("transactions", "is_flagged"), ("customers", "churn"))}
    assert issues(found["events"]) == [("outliers", "amount", "low"), ("time_split", "ALL", "medium")]
    assert found["customers"].count() == 3
    listed = found["customers"].filter("check = 'time_split'").first()["detail"]
    assert listed == "monthly_revenue, signup_date, last_login_date"
    assert [c[0] for c in issues(found["transactions"])] == ["outliers", "time_split"]


def test_use_cases(spark, tables):
    got = {}
    for r in matching.rank_use_cases(columns_table(spark, tables)).orderBy("dataset", "place").collect():
        got.setdefault(r["dataset"], []).append((r["use_case"], r["score"]))
    assert got["events"] == [
        ("Event Anomaly Detection", 3), ("Customer Churn Prediction", 1), ("Fraud Detection", 1),
        ("Revenue Forecasting", 1), ("Customer Segmentation", 1), ("Product Recommendation", 1)]
    assert got["transactions"][0] == ("Fraud Detection", 4) and got["transactions"][1] == ("Customer Churn Prediction", 2)
    assert got["customers"][:2] == [("Revenue Forecasting", 3), ("Lifetime Value Prediction", 3)]


def test_feature_groups_and_meanings(spark, tables):
    rows = matching.feature_groups(columns_table(spark, tables)).collect()
    of = lambda d, g: sorted(r["column"] for r in rows if r["dataset"] == d and r["group"] == g)
    assert of("events", "event") == ["event_id", "event_type", "status"]
    assert of("transactions", "transaction") == ["amount", "payment_method", "transaction_id"]
    assert of("customers", "transaction") == ["monthly_revenue", "total_orders"] and of("customers", "event") == []
    named = {r["column"]: r for r in profile.data_dictionary(tables["transactions"], "transaction_id").collect()}
    assert named["created_at"]["meaning"] == "date" and not named["created_at"]["is_likely_date"]
    assert named["country"]["meaning"] == "count" and named["customer_id"]["distinct_values"] == 33
