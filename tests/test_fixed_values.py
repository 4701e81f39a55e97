"""The word lists that results depend on, stated again: queries and their SQL read the same module, so neither notices a wrong word."""

from tablegauge.functions import fixed_values as V


def listed(text):
    """name: word, word; one list a line, in order."""
    return tuple((name.strip(), tuple(w.strip() for w in words.split(","))) for name, words in (line.split(":", 1) for line in text.strip().splitlines()))


def test_column_words():
    assert V.MEANING_RULES == listed("""
        identifier: id, key, uuid, guid
        date: date, time, timestamp, created, updated
        money: revenue, amount, price, cost, fee
        category: status, state, type, category, label
        count: count, qty, quantity, total, num
        text: name, title, description, text, comment""")
    assert V.FEATURE_GROUPS == listed("""
        time: date, time, timestamp, created, updated
        user: user, customer, account, member, client
        transaction: amount, revenue, price, transaction, payment, order, cost
        event: event, action, type, status, click, error, fail""")
    assert V.FEATURE_GROUPS_WIDE == listed("""
        time: date, time, timestamp, created, updated, day, hour
        user: user, customer, account, client, member
        transaction: revenue, amount, price, transaction, order, payment, cost
        event: event, action, type, status, click, view, error, fail""")
    assert " ".join(V.POSITIVE_NAME_WORDS) == "amount price cost revenue count qty quantity age duration size"
    assert " ".join(V.LEAKAGE_NAME_WORDS) == "future_ final_ _result _outcome _after post_ approved closed completed"
    assert " ".join(V.TIME_SPLIT_NAME_WORDS) == "date time timestamp created day month"
    assert " ".join(V.DATE_FLAG_WORDS) == "date time timestamp"


def test_sql_words():
    assert " ".join(V.BLOCKED_STRICT) == "DELETE UPDATE DROP ALTER INSERT CREATE MERGE TRUNCATE EXEC EXECUTE GRANT REVOKE ATTACH DETACH COPY"
    assert V.BLOCKED_BASIC == V.BLOCKED_STRICT[:10]
    assert " ".join(V.SQL_DATE_WORDS) == "date timestamp created_at updated_at day month year event_date order_date"


def test_matching_words():
    assert V.USE_CASES == listed("""
        Customer Churn Prediction: churn, status, customer, subscription, cancel, active
        Fraud Detection: transaction, payment, amount, fraud, fail, flag
        Revenue Forecasting: revenue, amount, date, order, sales, price
        Customer Segmentation: customer, user, segment, behaviour, rfm, spend
        Event Anomaly Detection: event, event_type, timestamp, log, error, fail
        Product Recommendation: product, item, purchase, order, user_id, click
        Demand Forecasting: quantity, demand, inventory, stock, sku, supply
        Lifetime Value Prediction: revenue, customer, lifetime, clv, ltv, spend""")
    assert V.PROBLEM_TYPES == listed("""
        classification: churn, fraud, default, click, convert, yes/no, binary, whether, classify, detect fraud
        forecasting: forecast, next month, next week, future, time series, trend, seasonal, demand, predict sales
        regression: price, revenue, cost, predict amount, forecast value, estimate, how much, score, rating, numeric
        clustering: segment, group, cluster, similar, profile, identify types, no label, unsupervised
        anomaly_detection: anomaly, outlier, unusual, abnormal, rare event, unexpected, intrusion, spike
        recommendation: recommend, suggestion, personaliz, collaborative, what to show, next product, next item
        ranking: rank, prioritize, score and sort, learning to rank, order by relevance""")
    assert V.COLUMN_KPIS == listed("""
        Total Revenue: revenue, amount, price, total
        Success/Failure Rate by Status: status, state, result
        Active Unique Users/Customers: user_id, customer_id, account_id
        Event Frequency by Type: event_type, event, action
        Daily/Weekly Trend: date, timestamp, created_at, event_date""")
    kpis = {domain: [f"{name}: {', '.join(words)}" for name, words in rows] for domain, rows in V.KPI_CATALOG.items()}
    assert kpis == {
        "ecommerce": ["Total Revenue: revenue, amount, price", "Average Order Value (AOV): revenue, order_id", "Repeat Purchase Rate: customer_id, order_id",
                      "Order Cancellation Rate: status, order_id", "Monthly Active Customers: customer_id"],
        "saas": ["Monthly Recurring Revenue (MRR): subscription_value, revenue", "Churn Rate: customer_id, status, churn",
                 "Net Revenue Retention (NRR): revenue, customer_id", "Customer Acquisition Cost (CAC): customer_id"],
        "fintech": ["Transaction Volume: transaction_id", "Failed Transaction Rate: status, transaction_id", "Average Transaction Amount: amount"],
        "events": ["Event Volume by Type: event_type", "Failed Event Rate: status", "Active Users per Day: user_id", "Events per Active User: user_id"],
    }


def test_text_words():
    assert V.INTENTS == listed("""
        sql: sql, query, select, join, where, table, database, duckdb
        dashboard: dashboard, kpi, chart, visualization, report, metric, trend
        data_science: ml, machine learning, predict, model, cluster, forecast, anomaly, feature, train, classification, regression, neural
        data_quality: missing, null, duplicate, quality, clean, invalid, outlier, validation, check, issue
        architecture: pipeline, architecture, infrastructure, deploy, kafka, airflow, design, system, workflow
        analytics: analyze, analysis, eda, explore, profile, summarize, insight, pattern, distribution""")
    assert " ".join(V.ANALYST_WORDS) == "profile csv data kpi dashboard sql query analyze quality missing duplicate chart report"
    assert " ".join(V.SCIENTIST_WORDS) == "ml model predict forecast cluster feature anomaly train classification regression pipeline"


def test_limits():
    assert (V.NULL_PCT_CRITICAL, V.NULL_PCT_HIGH, V.HIGH_CARDINALITY, V.Z_LIMIT, V.CLASS_LIMIT, V.MINORITY_SHARE) == (30, 10, 50, 3, 20, 0.1)
    assert (V.CATEGORICAL_DISTINCT, V.MAX_SELECTS, V.ROW_CAP) == (20, 3, 500)
    assert (V.CHARS_PER_TOKEN, V.CONTEXT_WINDOW, V.HISTORY_MESSAGES, V.HISTORY_CHARS, V.DIGEST_EDGE_LINES, V.DIGEST_CHARS) == (4, 8192, 6, 300, 3, 300)
    assert (V.CHANGE_SIGNIFICANT, V.CHANGE_MODERATE, V.RATE_LOW, V.RATE_MODERATE) == (25, 10, 1, 5)
    assert V.USAGE_BANDS == ((50, "safe"), (75, "moderate"), (90, "high")) and V.USAGE_TOP_BAND == "critical"
