"""The rules of the checks, dictionary, anomaly and text operators on small inline tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablegauge.operators import alerts, anomaly, features, kpi, matching, profile, quality, repair, risks, split, textjobs
from tablegauge.sources import schema as S


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def table(spark):
    data = [(i, float(i % 7), "x", None, float("nan") if i % 4 == 0 else 1.0, f"t{i}", -1.0 if i == 3 else 5.0) for i in range(60)]
    return spark.createDataFrame(data, "id long, score double, fixed string, empty string, holes double, label string, unit_price double")


def test_nan_counts_as_missing(table):
    assert rows(profile.null_counts(table), "column", "nulls") == [("empty", 60), ("holes", 15)]


def test_missing_severity_uses_strict_limits(spark):
    # exactly 30 % is high, exactly 10 % is medium
    data = [(None if i < 30 else 1, None if i < 10 else 1, None if i < 31 else 1) for i in range(100)]
    df = spark.createDataFrame(data, "a int, b int, c int")
    assert rows(quality.check_missing(df), "column", "severity", "pct") == [
        ("a", "high", 30.0), ("b", "medium", 10.0), ("c", "critical", 31.0)]


def test_constant_rule_differs_between_reports(table):
    assert rows(quality.check_constant(table), "column") == [("empty",), ("fixed",), ("holes",)]
    assert rows(risks.risk_constant(table), "column") == [("fixed",), ("holes",)]


def test_report_finds_each_kind_of_issue(table):
    found = {(r["check"], r["column"]) for r in quality.quality_report(table).collect()}
    assert found == {
        ("missing_values", "empty"), ("missing_values", "holes"), ("constant_column", "fixed"),
        ("constant_column", "empty"), ("constant_column", "holes"), ("high_cardinality", "label"),
        ("negative_values", "unit_price"), ("zscore_outliers", "unit_price")}


def test_clean_table_has_no_verdict(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    assert rows(quality.overall_verdict(quality.quality_report(df)), "issues", "verdict") == [(0, "none")]
    assert rows(risks.risk_verdict(risks.ml_risk_report(df)), "verdict") == [
        ("low or medium only: proceed with care",)]


def test_nested_columns_are_checked_for_nulls_only(spark):
    df = spark.createDataFrame([(1, [1]), (2, None), (3, [1])], "n int, a array<int>")
    assert rows(quality.quality_report(df), "check", "column") == [("missing_values", "a")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "n double, s string")
    assert rows(profile.missing_summary(df), "missing_cells", "missing_percent") == [(0, None)]
    assert rows(profile.duplicate_row_count(df), "duplicate_rows") == [(0,)]
    assert anomaly.anomaly_summary(df, "n").count() == 0
    assert {r["check"] for r in quality.quality_report(df).collect()} == {"constant_column"}


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (1, None)], "a int, b string")
    assert rows(profile.duplicate_row_count(df), "duplicate_rows") == [(2,)]


def test_no_spread_and_single_row_give_no_outliers(spark):
    flat = spark.createDataFrame([(5.0,)] * 30, "v double")
    one = spark.createDataFrame([(5.0,)], "v double")
    for df in (flat, one):
        assert quality.check_zscore_outliers(df).count() == 0
        assert anomaly.anomalies(df, "v", ["v"], "zscore").count() == 0


def test_anomaly_flags_use_population_and_limits_sample_deviation(spark):
    # the far value is 3.03 population deviations out but only 2.96 sample deviations
    df = spark.createDataFrame([(-1.0,), (1.0,)] * 10 + [(4.222,)], "v double")
    found = anomaly.anomalies(df, "v", ["v"], "zscore").collect()
    limit = anomaly.anomaly_thresholds(df, "v", "zscore").first()["upper"]
    assert len(found) == 1 and found[0]["z"] > 3 and found[0]["value"] < limit


def test_anomaly_refuses_bad_input(spark):
    df = spark.createDataFrame([(1.0, True, "a")], "v double, b boolean, s string")
    for column, method in (("v", "mad"), ("b", "iqr"), ("s", "iqr"), ("nope", "iqr")):
        with pytest.raises(ValueError):
            anomaly.anomalies(df, column, ["v"], method)


def test_name_rules_are_substring_tests(spark):
    names = ["l_discount", "country", "usage", "paid", "created_at", "valid", "monthly_revenue", "platform"]
    df = spark.createDataFrame([(n,) for n in names], "column string")
    got = dict((r["column"], r["meaning"]) for r in profile.column_meaning(df).collect())
    assert got == {"l_discount": "count", "country": "count", "usage": "unclear", "paid": "identifier",
                   "created_at": "date", "valid": "identifier", "monthly_revenue": "money", "platform": "unclear"}
    assert rows(risks.time_names(df), "column") == [("created_at",), ("monthly_revenue",)]


def test_integer_with_nulls_is_not_categorical(spark):
    df = spark.createDataFrame([(i % 3, None if i == 0 else i % 3, i) for i in range(30)], "level int, gaps int, ts_day int")
    facts = profile.column_role_flags(profile.column_facts(df))
    assert rows(facts, "column", "is_likely_categorical") == [("gaps", False), ("level", True), ("ts_day", False)]


def test_samples_follow_the_order_key(spark):
    df = spark.createDataFrame([(3, "c"), (1, "b"), (2, "b"), (4, "a"), (5, None)], "k int, v string")
    got = profile.column_samples(df, "k", columns=["v"]).first()["samples"]
    assert got == ["b", "c", "a"]


def test_temporal_columns_count_as_text_on_request(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(i),) for i in range(60)], "signup_date date")
    assert quality.check_high_cardinality(df).count() == 0
    assert quality.check_high_cardinality(df, temporal_as_string=True).first()["affected"] == 60
    assert S.text_columns(df, True) == ["signup_date"]


def test_repairs(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, "b"), (100.0, None)], "v double, c string")
    assert rows(repair.impute(df, ["v"], "median"), "v") == [(1.0,), (3.0,), (3.0,), (100.0,)]
    assert sorted(r["c"] for r in repair.impute(df, ["c"], "mode").collect()) == ["a", "b", "b", "b"]
    assert repair.drop_constant_columns(df.withColumn("k", F.lit(1))).columns == ["v", "c"]
    log = repair.log_transform(spark.createDataFrame([(-2.0,), (0.0,)], "v double"), ["v"])
    assert [r["v"] for r in log.collect()] == [None, 0.0]


def test_target_encoding_is_fitted_on_train_only(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0), (None, 2.0)], "c string, y double")
    out = repair.target_encode(df, "c", "y", train=df.filter("c = 'a' or c is null"))
    got = {r["c"]: r["c_encoded"] for r in out.collect()}
    assert got == {"a": 2.0, None: 2.0, "b": 2.0}


def test_class_imbalance_limits(spark):
    df = spark.createDataFrame([(int(i < 10),) for i in range(100)], "y int")
    assert risks.risk_class_imbalance(df, "y").count() == 0  # exactly a tenth
    many = spark.createDataFrame([(i,) for i in range(21)], "y int")
    assert risks.risk_class_imbalance(many, "y").count() == 0  # 21 numeric classes
    text = many.select(F.col("y").cast("string").alias("y"))
    assert risks.risk_class_imbalance(text, "y").count() == 1


def test_leakage_ignores_the_target(spark):
    df = spark.createDataFrame([(1, 1)], "Final_Result int, approved_at int")
    assert rows(risks.risk_leakage_names(df, "final_result"), "column") == [("approved_at",)]


def test_temporal_split_keeps_equal_times_together(spark):
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + i // 5)) for i in range(20)], "k int, ts timestamp")
    got = split.temporal_split(df, "ts", 0.6).groupBy("split").count()
    assert rows(got, "split", "count") == [("test", 5), ("train", 15)]


def test_change_bands(spark):
    data = [(dt.datetime(2024, m, 1), v) for m, v in ((1, 100.0), (2, 125.0), (3, 112.5), (4, 112.6), (5, 104.0))]
    df = spark.createDataFrame(data, "period timestamp, value double")
    got = rows(alerts.explain_change(df, "churn_rate"), "period", "severity", "direction")
    assert [g[1:] for g in got] == [
        ("significant", "increasing"), ("moderate", "decreasing"), ("minor", "stable"), ("minor", "decreasing")]


def test_division_by_zero_is_null(spark):
    data = [(dt.datetime(2024, m, 1), v) for m, v in ((1, 0.0), (2, 5.0))]
    df = spark.createDataFrame(data, "period timestamp, value double")
    assert alerts.with_change(df).filter("change_pct is not null").count() == 0


def test_net_revenue_retention_counts_each_move_once(spark):
    jan, feb = dt.datetime(2024, 1, 5), dt.datetime(2024, 2, 5)
    data = [("a", jan, 100.0), ("a", feb, 150.0), ("b", jan, 100.0), ("b", feb, 60.0), ("c", jan, 50.0), ("d", feb, 999.0)]
    got = kpi.net_revenue_retention(spark.createDataFrame(data, "c string, ts timestamp, v double"), "c", "v", "ts").first()
    assert (got["start"], got["expansion"], got["contraction"], got["churned"]) == (250.0, 50.0, 40.0, 50.0)
    assert got["value"] == pytest.approx(210 / 250)


def test_weekend_and_business_hours(spark):
    times = [dt.datetime(2024, 1, 5, 9), dt.datetime(2024, 1, 5, 18), dt.datetime(2024, 1, 6, 12)]
    out = features.time_parts(spark.createDataFrame([(t,) for t in times], "ts timestamp"), "ts")
    assert rows(out, "day_of_week", "is_weekend", "is_business_hours") == [
        (4, False, False), (4, False, True), (5, True, False)]


@pytest.mark.parametrize("text,intent", [
    ("Create a KPI dashboard for revenue", "dashboard"),
    ("Train a model to predict churn using ML", "data_science"),
    ("Write a SELECT query to join orders and customers", "sql"),
    ("Find missing values and duplicate rows in my dataset", "data_quality"),
    ("", "analytics"),
    ("forecast with sql", "mixed"),
])
def test_intents(spark, text, intent):
    df = spark.createDataFrame([(text,)], "t string")
    assert textjobs.classify_requests(df, "t").first()["intent"] == intent


@pytest.mark.parametrize("goal,kind", [
    ("predict churn", "classification"), ("how much revenue will we make", "regression"),
    ("segment customers", "clustering"), ("forecast sales", "forecasting"),
    ("find unusual spikes", "anomaly_detection"), ("hello", "classification"),
])
def test_problem_types(spark, goal, kind):
    df = spark.createDataFrame([(goal,)], "g string")
    assert df.select(matching.recommend_problem_type(F.col("g")).alias("k")).first()["k"] == kind


@pytest.mark.parametrize("chars,window,tokens,band", [
    (400, 8192, 100, "safe"), (30000, 8192, 7500, "critical"), (4000, 2000, 1000, "moderate"), (0, 100, 0, "safe"), (2, 100, 1, "safe"),
])
def test_context_usage(spark, chars, window, tokens, band):
    got = textjobs.context_usage(spark.createDataFrame([("x" * chars,)], "t string"), "t", window).first()
    assert (got["tokens"], got["band"]) == (tokens, band)


def test_sections(spark):
    from tablegauge.functions.fixed_values import REPORT_SECTIONS

    full = "\n".join(REPORT_SECTIONS)
    odd = full.replace("Direct Answer", "direct_answer").replace("Next Steps", "NEXT-STEPS")
    df = spark.createDataFrame([(full,), (odd,), (full.replace("Next Steps", ""),)], "t string")
    got = textjobs.section_completeness(df, "t")
    assert rows(got, "score_percent", "is_complete") == [(90.0, False), (100.0, True), (100.0, True)]


def test_digest_of_short_and_long_conversations(spark):
    short = [(1, i, "user" if i % 2 == 0 else "assistant", f"line {i}") for i in range(4)]
    long = [(2, i, "system", f"m{i}\n\n  n{i} ") for i in range(5)]
    df = spark.createDataFrame(short + long, "c int, turn int, role string, text string")
    got = {r["c"]: r for r in textjobs.conversation_digest(df, "c", "turn", "role", "text").collect()}
    assert got[1]["message_count"] == 4 and got[1]["last_user"] == "line 2"
    assert got[1]["condensed"] == "USER: line 0 | ASSISTANT: line 1 | USER: line 2 | ASSISTANT: line 3"
    assert got[2]["message_count"] == 10 and got[2]["last_user"] is None
    assert got[2]["condensed"] == "ASSISTANT: m0 | n0 | ASSISTANT: m1 | [... earlier messages ...] | n3 | ASSISTANT: m4 | n4"


def test_use_cases_keep_library_order_on_ties(spark):
    df = spark.createDataFrame([("d", "customer_id"), ("d", "error"), ("e", "zzz")], "dataset string, column string")
    got = sorted((r["dataset"], r["place"], r["use_case"], r["score"]) for r in matching.rank_use_cases(df).collect())
    assert [g[2] for g in got if g[0] == "d"] == [
        "Customer Churn Prediction", "Customer Segmentation", "Event Anomaly Detection", "Lifetime Value Prediction"]
    assert [g[2:] for g in got if g[0] == "e"] == [("General Analytics Exploration", 0)]


def test_empty_domain_matches_the_first_library(spark):
    df = spark.createDataFrame([("",), ("FinTech app",), ("zoo",)], "d string")
    got = [r[0] for r in df.select(matching.match_domain(F.col("d"))).collect()]
    assert got == ["ecommerce", "fintech", None]


def test_a_value_that_falls_silent_has_fallen_to_zero(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [(day(d), "a", 10) for d in range(1, 8)] + [(day(d), "b", 10) for d in (1, 2, 3)] + [(day(5), "c", 4), (day(7), "c", 4)]
    series = spark.createDataFrame(rows, "period timestamp, kind string, value long")
    got = {(r.kind, r.period.day) for r in alerts.alert_dim_drop(series, "kind", grain="day").collect()}
    assert got == {("b", 4), ("c", 6)}
    assert alerts.alert_dim_drop(series, "kind").count() == 0
    one = series.where("kind = 'c'").select("period", "value")
    assert [(r.period.day, r.value) for r in alerts.alert_vs_trailing_avg(one, grain="day").collect()] == [(6, 0)]
    gap = spark.createDataFrame([(day(d), 5) for d in (1, 2, 9)], "period timestamp, value long")
    assert {r.period.day for r in alerts.alert_vs_prior_week(gap, grain="day").collect()} == {8}
