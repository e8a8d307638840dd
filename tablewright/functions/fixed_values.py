"""Fixed values.

Word lists, thresholds, labels and patterns that decide a result. They have to
hold exactly these values for results to agree with the specification, so they
are stated here as plain data and nowhere else.
"""

# --- loading -----------------------------------------------------------------
# Text that the pandas CSV reader documents as "missing" by default.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
FORMULA_STARTS = ["=", "+", "-", "@"]

# --- quality score -----------------------------------------------------------
MISSING_PENALTY = 2.0
DUPLICATE_PENALTY = 5.0
HIGH_CARDINALITY_PENALTY = 3.0
HIGH_CARDINALITY_RATIO = 0.9
SCORE_BUCKETS = [(90, "Green"), (70, "Blue"), (50, "Orange")]
LOWEST_BUCKET = "Red"

# --- cleaning ----------------------------------------------------------------
DATE_NAME_WORDS = ["date", "time"]
NUMERIC_TEXT_SHARE = 0.9
# (pattern, replacement) pairs that turn a column label into snake_case.
SNAKE_CASE_PATTERNS = [
    (r"[^a-zA-Z0-9]", "_"),
    (r"(.)([A-Z][a-z]+)", r"\1_\2"),
    (r"([a-z0-9])([A-Z])", r"\1_\2"),
    (r"_+", "_"),
]

# --- missing-value causes ----------------------------------------------------
SEGMENT_MAX_DISTINCT = 15
SEGMENT_MIN_PERCENT = 50.0
SEGMENT_MIN_ROWS = 3
CRITICAL_MISSING_PERCENT = 50.0
HIGH_MISSING_PERCENT = 20.0
OUTAGE_RUN = 10
OPTIONAL_WORDS = [
    "middle", "suffix", "phone", "fax", "website", "optional", "comment",
    "notes", "address2", "secondary",
]
NOT_APPLICABLE_WORDS = [
    "spouse", "dependents", "bonus", "commission", "marriage", "partner",
    "children",
]
SENSITIVE_WORDS = [
    "password", "ssn", "tax", "income", "salary", "salary_amount",
    "national_id", "passport",
]

# --- outliers ----------------------------------------------------------------
OUTLIER_SKIP_WORDS = ["id", "key", "code", "zip", "postal", "num"]
OUTLIER_MIN_VALUES = 5
IQR_FACTOR = 1.5
Z_LIMIT = 3.0
MODIFIED_Z_FACTOR = 0.6745
MODIFIED_Z_LIMIT = 3.5
OUTLIER_SAMPLE_ROWS = 15
NEVER_NEGATIVE_WORDS = [
    "age", "salary", "revenue", "price", "amount", "spend", "quantity",
]
GENUINE_VALUE_WORDS = [
    "sales", "revenue", "profit", "spend", "amount", "salary", "income",
]
FRAUD_WORDS = ["transaction", "transfer", "amount", "withdrawal", "payment"]

# --- column roles, cards and charts ------------------------------------------
ROLE_DATE_WORDS = ["date", "time", "year", "month"]
ROLE_ID_WORDS = ["id", "key", "code", "num", "pk"]
BOOLEAN_WORDS = ["true", "false", "0", "1", "yes", "no", "y", "n"]
MONEY_CARD_WORDS = ["sales", "revenue", "amount", "spend", "price"]
PROFIT_CARD_WORDS = ["profit", "margin", "gain", "income"]
RATING_CARD_WORDS = ["rating", "score", "satisfaction"]
CUSTOMER_ID_WORDS = ["customer", "user", "client"]
ORDER_ID_WORDS = ["order", "invoice", "trans"]
LINE_METRIC_WORDS = ["sales", "revenue", "profit", "spend", "amount"]
BAR_METRIC_WORDS = ["sales", "revenue", "profit", "amount"]
GEO_CHART_WORDS = [
    "city", "region", "country", "state", "postal", "zip", "lat", "lon",
]
MAX_CARDS = 4
MAX_CHARTS = 6

# --- questions ---------------------------------------------------------------
DIAGNOSTIC_WORDS = [
    "why", "reason", "cause", "explain", "insight", "decline", "decrease",
    "drop", "fall", "down", "increase", "rise", "growth", "grew", "up",
    "trending", "trend", "perform", "performing", "underperform",
    "outperform", "compare", "comparison", "versus", "vs", "best", "worst",
    "improve", "weak", "strong",
]
METRIC_WORDS = [
    "revenue", "sales", "profit", "amount", "total", "average", "avg", "sum",
    "highest", "lowest", "income", "cost", "price", "value", "quantity",
]
GROUPING_WORDS = ["by ", "wise", "per ", "each ", "across ", "section", "segment"]
CALENDAR_WORDS = [
    "month", "year", "day", "trend", "date", "monthly", "daily", "yearly",
    "quarter",
]
FOLLOW_UP_PHRASES = ["what about", "and the", "how about"]
# (operation, words, sort); the first list with a hit decides.
OPERATION_WORDS = [
    ("sum", ["total", "sum"], None),
    ("mean", ["average", "avg", "mean"], None),
    ("count", ["count", "how many"], None),
    ("max", ["highest", "max", "maximum", "peak"], "desc"),
    ("min", ["lowest", "min", "minimum", "bottom"], "asc"),
]
TOP_N_PATTERN = r"top\s+(\d+)"
PIE_WORDS = ["contribution", "share", "percent", "pie"]
BAR_ROWS = 15
PIE_ROWS = 6
STRONG_CORRELATION = 0.6
MODERATE_CORRELATION = 0.3

# --- story -------------------------------------------------------------------
STORY_METRIC_WORDS = ["sales", "revenue", "profit", "amount", "total"]
STORY_GEO_WORDS = ["city", "region", "country", "state", "location"]
STORY_SEGMENTS = (2, 20)
MAX_INSIGHTS = 10
