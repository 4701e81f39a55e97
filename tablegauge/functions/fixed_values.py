"""Word lists, thresholds and rule orders that results depend on.

These are fixed values: they must stay as they are, in this order, for results to
be right. All words are matched as substrings of lower-cased text unless noted.
"""

# --- quality and risk checks -------------------------------------------------
POSITIVE_NAME_WORDS = (
    "amount", "price", "cost", "revenue", "count", "qty", "quantity", "age", "duration", "size",
)
LEAKAGE_NAME_WORDS = (
    "future_", "final_", "_result", "_outcome", "_after", "post_", "approved", "closed", "completed",
)
TIME_SPLIT_NAME_WORDS = ("date", "time", "timestamp", "created", "day", "month")
SEVERITIES = ("critical", "high", "medium", "low")
NULL_PCT_CRITICAL = 30
NULL_PCT_HIGH = 10
HIGH_CARDINALITY = 50
Z_LIMIT = 3
CLASS_LIMIT = 20
MINORITY_SHARE = 0.1

# --- data dictionary: first matching rule wins --------------------------------
MEANING_RULES = (
    ("identifier", ("id", "key", "uuid", "guid")),
    ("date", ("date", "time", "timestamp", "created", "updated")),
    ("money", ("revenue", "amount", "price", "cost", "fee")),
    ("category", ("status", "state", "type", "category", "label")),
    ("count", ("count", "qty", "quantity", "total", "num")),
    ("text", ("name", "title", "description", "text", "comment")),
)
DATE_FLAG_WORDS = ("date", "time", "timestamp")
CATEGORICAL_DISTINCT = 20

# --- SQL guard: whole words, order decides which one is reported --------------
BLOCKED_BASIC = (
    "DELETE", "UPDATE", "DROP", "ALTER", "INSERT",
    "CREATE", "MERGE", "TRUNCATE", "EXEC", "EXECUTE",
)
BLOCKED_STRICT = BLOCKED_BASIC + ("GRANT", "REVOKE", "ATTACH", "DETACH", "COPY")
SQL_DATE_WORDS = (
    "date", "timestamp", "created_at", "updated_at", "day", "month", "year", "event_date", "order_date",
)
MAX_SELECTS = 3
ROW_CAP = 500

# --- use cases and the column-name words that point to them -------------------
USE_CASES = (
    ("Customer Churn Prediction",
     ("churn", "status", "customer", "subscription", "cancel", "active")),
    ("Fraud Detection",
     ("transaction", "payment", "amount", "fraud", "fail", "flag")),
    ("Revenue Forecasting",
     ("revenue", "amount", "date", "order", "sales", "price")),
    ("Customer Segmentation",
     ("customer", "user", "segment", "behaviour", "rfm", "spend")),
    ("Event Anomaly Detection",
     ("event", "event_type", "timestamp", "log", "error", "fail")),
    ("Product Recommendation",
     ("product", "item", "purchase", "order", "user_id", "click")),
    ("Demand Forecasting",
     ("quantity", "demand", "inventory", "stock", "sku", "supply")),
    ("Lifetime Value Prediction",
     ("revenue", "customer", "lifetime", "clv", "ltv", "spend")),
)
NO_USE_CASE = "General Analytics Exploration"

# --- KPI names per domain with the column words they need ---------------------
KPI_CATALOG = {
    "ecommerce": (
        ("Total Revenue", ("revenue", "amount", "price")),
        ("Average Order Value (AOV)", ("revenue", "order_id")),
        ("Repeat Purchase Rate", ("customer_id", "order_id")),
        ("Order Cancellation Rate", ("status", "order_id")),
        ("Monthly Active Customers", ("customer_id",)),
    ),
    "saas": (
        ("Monthly Recurring Revenue (MRR)", ("subscription_value", "revenue")),
        ("Churn Rate", ("customer_id", "status", "churn")),
        ("Net Revenue Retention (NRR)", ("revenue", "customer_id")),
        ("Customer Acquisition Cost (CAC)", ("customer_id",)),
    ),
    "fintech": (
        ("Transaction Volume", ("transaction_id",)),
        ("Failed Transaction Rate", ("status", "transaction_id")),
        ("Average Transaction Amount", ("amount",)),
    ),
    "events": (
        ("Event Volume by Type", ("event_type",)),
        ("Failed Event Rate", ("status",)),
        ("Active Users per Day", ("user_id",)),
        ("Events per Active User", ("user_id",)),
    ),
}
SUGGESTED_KPIS = {
    "ecommerce": (
        "Total Revenue", "Average Order Value (AOV)", "Repeat Purchase Rate",
        "Order Cancellation Rate", "Monthly Active Customers", "Customer Lifetime Value (CLV)",
    ),
    "saas": (
        "Monthly Recurring Revenue (MRR)", "Churn Rate", "Customer Acquisition Cost (CAC)",
        "Net Revenue Retention (NRR)", "Daily Active Users (DAU)",
    ),
    "fintech": (
        "Transaction Volume", "Average Transaction Amount", "Failed Transaction Rate",
        "Customer Onboarding Rate",
    ),
    "healthcare": (
        "Patient Readmission Rate", "Average Length of Stay", "Appointment No-Show Rate",
    ),
}
# exact column names, not substrings
COLUMN_KPIS = (
    ("Total Revenue", ("revenue", "amount", "price", "total")),
    ("Success/Failure Rate by Status", ("status", "state", "result")),
    ("Active Unique Users/Customers", ("user_id", "customer_id", "account_id")),
    ("Event Frequency by Type", ("event_type", "event", "action")),
    ("Daily/Weekly Trend", ("date", "timestamp", "created_at", "event_date")),
)

# --- feature groups by column-name words; the second set has a few more words --
FEATURE_GROUPS = (
    ("time", ("date", "time", "timestamp", "created", "updated")),
    ("user", ("user", "customer", "account", "member", "client")),
    ("transaction", ("amount", "revenue", "price", "transaction", "payment", "order", "cost")),
    ("event", ("event", "action", "type", "status", "click", "error", "fail")),
)
FEATURE_GROUPS_WIDE = (
    ("time", ("date", "time", "timestamp", "created", "updated", "day", "hour")),
    ("user", ("user", "customer", "account", "client", "member")),
    ("transaction", ("revenue", "amount", "price", "transaction", "order", "payment", "cost")),
    ("event", ("event", "action", "type", "status", "click", "view", "error", "fail")),
)

# --- problem type of a goal: first matching rule wins --------------------------
PROBLEM_TYPES = (
    ("classification",
     ("churn", "fraud", "default", "click", "convert", "yes/no", "binary", "whether", "classify",
      "detect fraud")),
    ("forecasting",
     ("forecast", "next month", "next week", "future", "time series", "trend", "seasonal", "demand",
      "predict sales")),
    ("regression",
     ("price", "revenue", "cost", "predict amount", "forecast value", "estimate", "how much",
      "score", "rating", "numeric")),
    ("clustering",
     ("segment", "group", "cluster", "similar", "profile", "identify types", "no label",
      "unsupervised")),
    ("anomaly_detection",
     ("anomaly", "outlier", "unusual", "abnormal", "rare event", "unexpected", "intrusion", "spike")),
    ("recommendation",
     ("recommend", "suggestion", "personaliz", "collaborative", "what to show", "next product",
      "next item")),
    ("ranking",
     ("rank", "prioritize", "score and sort", "learning to rank", "order by relevance")),
)
DEFAULT_PROBLEM_TYPE = "classification"
RECALL_WORDS = ("miss", "costly", "expensive", "critical", "fraud", "churn", "disease")
PRECISION_WORDS = ("false alarm", "alert fatigue", "compliance", "precision")

# --- request intents, in report order ------------------------------------------
INTENTS = (
    ("sql", ("sql", "query", "select", "join", "where", "table", "database", "duckdb")),
    ("dashboard", ("dashboard", "kpi", "chart", "visualization", "report", "metric", "trend")),
    ("data_science",
     ("ml", "machine learning", "predict", "model", "cluster", "forecast", "anomaly", "feature",
      "train", "classification", "regression", "neural")),
    ("data_quality",
     ("missing", "null", "duplicate", "quality", "clean", "invalid", "outlier", "validation", "check",
      "issue")),
    ("architecture",
     ("pipeline", "architecture", "infrastructure", "deploy", "kafka", "airflow", "design", "system",
      "workflow")),
    ("analytics",
     ("analyze", "analysis", "eda", "explore", "profile", "summarize", "insight", "pattern",
      "distribution")),
)
INTENT_ROUTES = {
    "sql": "analyst",
    "dashboard": "analyst",
    "data_quality": "analyst",
    "analytics": "analyst",
    "data_science": "scientist",
    "architecture": "supervisor",
    "mixed": "supervisor",
}
ANALYST_WORDS = (
    "profile", "csv", "data", "kpi", "dashboard", "sql", "query", "analyze", "quality", "missing",
    "duplicate", "chart", "report",
)
SCIENTIST_WORDS = (
    "ml", "model", "predict", "forecast", "cluster", "feature", "anomaly", "train", "classification",
    "regression", "pipeline",
)
SQL_STEP_WORDS = ("sql", "query")
# steps of a work plan: before, per specialist, with SQL words, after
PLAN_STEPS_BEFORE = ("classify_request", "context_usage")
PLAN_STEPS_ANALYST = ("profile", "quality_report", "kpis", "dashboard_data")
PLAN_STEPS_SQL = ("sql_audit",)
PLAN_STEPS_SCIENTIST = ("problem_type", "ml_risks", "features", "evaluation_metrics", "ml_plan")
PLAN_STEPS_AFTER = ("collect", "section_check", "combine")

# --- conversations ---------------------------------------------------------------
TOPICS = (
    ("agents", ("crewai", "agent", "supervisor")),
    ("local_model", ("ollama", "llm", "model")),
    ("tools", ("mcp", "server", "tool")),
    ("ui", ("streamlit", "ui", "dashboard")),
    ("data", ("csv", "data", "dataset", "pandas")),
    ("machine_learning", ("ml", "machine learning", "model", "predict")),
)
DIGEST_EDGE_LINES = 3
DIGEST_CHARS = 300
LAST_USER_CHARS = 200
EARLIER_MARK = "[... earlier messages ...]"
HISTORY_MESSAGES = 6
HISTORY_CHARS = 300
CHARS_PER_TOKEN = 4
CONTEXT_WINDOW = 8192
USAGE_BANDS = ((50, "safe"), (75, "moderate"), (90, "high"))
USAGE_TOP_BAND = "critical"
REPORT_SECTIONS = (
    "Direct Answer", "Dataset Summary", "Data Quality Findings", "Recommended KPIs",
    "Recommended Dashboard", "ML Use Cases", "Feature Engineering Ideas", "Risks and Limitations",
    "Next Steps", "Agent Work Summary",
)

# --- change bands ------------------------------------------------------------------
CHANGE_SIGNIFICANT = 25
CHANGE_MODERATE = 10
RATE_LOW = 1
RATE_MODERATE = 5
