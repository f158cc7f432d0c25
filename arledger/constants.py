"""Domain constants.

FIXED VALUES: the code lists, labels, thresholds and feature lists below must equal the
published receivables model's configuration for results to agree. They are stated once, in
natural order, and imported everywhere else.
"""

from __future__ import annotations

# --- fixed values: ERP code -> label maps ----------------------------------------------------
INDUSTRY_MAP = {
    "EN": "Energy",
    "MF": "Manufacturing",
    "RT": "Retail",
    "HC": "Healthcare",
    "CN": "Construction",
    "LG": "Logistics",
}
REGION_MAP = {
    "TX": "South",
    "NY": "Northeast",
    "IL": "Midwest",
    "CA": "West",
    "INTL": "International",
}
INDUSTRY_DEFAULT = "Other"
REGION_DEFAULT = "International"
# inverse-map defaults used when only legacy label columns exist
INDUSTRY_CODE_DEFAULT = "MF"
REGION_CODE_DEFAULT = "INTL"

# --- fixed values: payment terms (days) ------------------------------------------------------
PAYMENT_TERMS = {"NT14": 14, "NT30": 30, "NT45": 45, "NT60": 60, "NT90": 90}

# --- fixed values: aging buckets, in report order ---------------------------------------------
AGING_BUCKETS = ["Current", "1-30 days", "31-60 days", "61-90 days", "91-180 days", "180+ days"]
# upper bounds (days overdue, inclusive) of the first five buckets; the rest (and null) is last
AGING_BOUNDS = [0, 30, 60, 90, 180]

# --- fixed values: GL account names (EDA) -----------------------------------------------------
GL_ACCOUNT_NAMES = {
    "100000": "Petty Cash",
    "113100": "Bank Account - Operating",
    "113200": "Bank Account - Payroll",
    "113300": "Bank Account - Collections",
}

# --- fixed values: risk tier cut points on the late rate -------------------------------------
TIER_LOW_MAX = 0.20
TIER_MEDIUM_MAX = 0.50
TIER_LABELS = ["Low", "Medium", "High"]

# --- fixed values: classifier features and target ---------------------------------------------
FEATURE_COLS = [
    "LOG_AMOUNT",
    "PAYMENT_DAYS_NUM",
    "INDUSTRY_CODE",
    "REGION_CODE",
    "CUST_AVG_DAYS_LATE",
    "CUST_LATE_RATE",
    "CUST_INVOICE_COUNT",
    "CUST_AVG_AMOUNT",
    "INVOICE_MONTH",
    "INVOICE_QUARTER",
    "INVOICE_DOW",
    "IS_QUARTER_END",
]
TARGET_COL = "LATE_FLAG"
TEST_SIZE = 0.2
RANDOM_SEED = 42
CV_FOLDS = 5

# feature store output columns, in order
FEATURE_STORE_COLS = [
    "BELNR",
    "KUNNR",
    "BLDAT",
    "FAEDT",
    "DMBTR",
    "INDUSTRY",
    "REGION",
    "ZTERM",
    "RISK_TIER",
    "STATUS",
    *FEATURE_COLS,
    "CUST_ROLLING3_DAYS_LATE",
    "CUST_LATE_TREND",
    "CUST_MAX_INVOICE",
    "CUST_AMOUNT_CONCENTRATION",
    "CUST_TOTAL_EXPOSURE",
    "INVOICE_TO_CREDIT_RATIO",
    "ACTUAL_TERM_DAYS",
    "IS_MONTH_END",
    "IS_MONDAY",
    "LOG_CASH_POSITION",
    "FISCPER",
    "LATE_FLAG",
    "DAYS_LATE",
]

# --- fixed values: classifier threshold search ------------------------------------------------
THRESHOLD_GRID_START = 0.2
THRESHOLD_GRID_STOP = 0.8
THRESHOLD_GRID_STEP = 0.01
SENSITIVITY_GRID_START = 0.1
SENSITIVITY_GRID_STOP = 0.9
MAX_FLAG_RATE_CAP = 0.85
MAX_FLAG_RATE_MARGIN = 0.10
MAX_FLAG_RATE_FALLBACK = 0.95

# --- fixed values: risk label bins on the probability (right-closed) --------------------------
RISK_LABEL_BOUNDS = [0.0, 0.3, 0.6, 1.0]

# --- fixed values: forecaster -----------------------------------------------------------------
FORECAST_FEATURE_COLS = [
    "MONTH",
    "QUARTER",
    "IS_Q_END",
    "MONTH_SIN",
    "MONTH_COS",
    "COLLECTIONS_LAG1",
    "COLLECTIONS_LAG2",
    "COLLECTIONS_LAG3",
    "LATE_RATE_LAG1",
    "LATE_RATE_LAG2",
    "AVG_LATE_PROB",
    "HIGH_RISK_SHARE",
    "N_INVOICES_CLEARED",
    "COLLECTIONS_ROLL3_MEAN",
    "COLLECTIONS_ROLL3_STD",
    "LOG_OPENING_CASH",
    "LOG_OPEN_AR",
]
FORECAST_HORIZONS = [30, 60, 90]
FORECAST_QUANTILES = [0.1, 0.5, 0.9]
SEGMENT_COLUMN = "REGION"
MIN_MONTHS_FOR_SEGMENT_MODEL = 24
MIN_CLEARED_FOR_SEGMENT_MODEL = 250
MIN_ROWS_FOR_FORECAST_DATASET = 12

# --- fixed values: dashboard -------------------------------------------------------------------
TOP_N_RISKS = 20
HIGH_RISK_PROB = 0.7
ELEVATED_RISK_BAND = 0.5

# --- fixed values: attribution ------------------------------------------------------------------
BACKGROUND_ROWS = 200
MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# --- adapter constants for the driver tables (not from the reference) -------------------------
PRIORITY_TERMS = {
    "1-URGENT": "NT14",
    "2-HIGH": "NT30",
    "3-MEDIUM": "NT45",
    "4-NOT SPECIFIED": "NT60",
    "5-LOW": "NT90",
}
RETURNFLAG_ACCOUNT = {"A": "113100", "N": "113200", "R": "113300"}
COMPANY_CODE = "1000"
CURRENCY = "USD"

# stand-in probability used before a model exists: shrunk prior late rate
STANDIN_PRIOR_RATE = 0.66
STANDIN_PRIOR_WEIGHT = 3
