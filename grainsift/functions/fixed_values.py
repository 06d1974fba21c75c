"""Word lists, patterns, thresholds and texts that define the results."""

# --- fixed values: missing-value words of a CSV file --------------------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: placeholder words, compared after lower-casing -------------------
SENTINELS = [
    "n/a", "na", "null", "none", "?", "-", "--", "9999", "-1", "-99", "-999", "-9999",
    "missing", "unknown",
]

# --- fixed values: thresholds -------------------------------------------------------
IQR_MULTIPLIER = 1.5
Z_SCORE_THRESHOLD = 3.0
MODIFIED_Z_SCALE = 0.6745
FUZZY_MATCH_THRESHOLD = 85.0
SEMANTIC_SIMILARITY = 0.85
LOW_VARIANCE_THRESHOLD = 0.95
CORRELATION_THRESHOLD = 0.98
PROXY_THRESHOLD = 0.65
HIGH_CARDINALITY_RATIO = 0.5
HIGH_CARDINALITY_MIN = 20
TEXT_MIN_MEAN_LENGTH = 20
FOREST_CONTAMINATION = 0.05
FOREST_SEED = 42

# --- fixed values: class balance bands (name, lower bound) --------------------------
IMBALANCE_BANDS = [
    ("BALANCED", 0.0),
    ("MILD", 1.5),
    ("MODERATE", 3.0),
    ("SEVERE", 10.0),
    ("EXTREME", 100.0),
]
IMBALANCE_BANDS_DISPLAY = [
    ("BALANCED", 0.0),
    ("MILD", 1.5),
    ("MODERATE", 3.0),
    ("EXTREME", 10.0),
]

# --- fixed values: balance advice ----------------------------------------------------
STRATEGY_SEVERE = "SMOTE oversampling or cost-sensitive learning (class_weight='balanced')"
STRATEGY_MODERATE = "Random oversampling / SMOTE, or adjust class weights in model"
STRATEGY_NONE = "Dataset is reasonably balanced — no special strategy required"
STRATEGY_NO_TARGET = "No target column provided."

# --- fixed values: grades (grade, lower bound) ---------------------------------------
GRADES = [("A", 90.0), ("B", 80.0), ("C", 70.0), ("D", 60.0)]
LOWEST_GRADE = "F"

# --- fixed values: weights and constants of the basic score -------------------------
BASIC_WEIGHTS = {
    "completeness": 0.3, "uniqueness": 0.2, "consistency": 0.2, "validity": 0.15, "balance": 0.15,
}
BASIC_CONSISTENCY = 95.0
BASIC_VALIDITY = 90.0
BASIC_BALANCE = 85.0

# --- fixed values: sensitive column names and privileged groups ---------------------
SENSITIVE_NAME_PATTERN = (
    r"\b(gender|sex|race|ethnicity|nationality|religion|age|disability|marital.?status|"
    r"location|zip|postal|income|salary)\b"
)
PRIVILEGED_GROUPS = {
    "gender": ["male", "m", "man"],
    "sex": ["male", "m"],
    "race": ["white", "caucasian"],
    "ethnicity": ["white", "caucasian"],
}

# --- fixed values: value-kind patterns -----------------------------------------------
PLAIN_NUMBER_PATTERN = r"^-?\d+(\.\d+)?$"
NUMERIC_LIKE_PATTERN = r"^[\$\€\£]?\s*\-?[\d,]+(?:\.\d+)?\s*[kKmMbB]?\s*$"
INTEGER_PATTERN = r"^-?\d+$"
FLOAT_PATTERN = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"
BOOLEAN_PATTERN = r"(?i)^(true|false|yes|no|1|0|t|f|y|n)$"
DATE_PATTERN = r"^\d{4}[-/]\d{2}[-/]\d{2}|^\d{2}[-/]\d{2}[-/]\d{4}|^\d{4}\d{2}\d{2}$"
TRUE_WORDS = ["true", "yes", "1", "t", "y"]
FALSE_WORDS = ["false", "no", "0", "f", "n"]
NUMBER_TEXT_PATTERN = r"(?i)^[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?$|^[+-]?inf(inity)?$"
#: dates with the year in front and at the end, of two or four digits a part, and of eight digits
DATE_YEAR_FIRST = r"^\d{4}[-/]\d{2}[-/]\d{2}([T ]\d{2}:\d{2}.*)?$"
DATE_YEAR_LAST = r"^\d{2}[-/]\d{2}[-/]\d{4}( \d{2}:\d{2}(:\d{2})?)?$"
DATE_DIGITS = r"^\d{8}$"

# --- fixed values: shares and counts of type inference --------------------------------
TYPE_SHARE = 0.90
DATE_SHARE = 0.85
CATEGORY_VALUES = 30
CATEGORY_SHARE = 0.10

# --- fixed values: personal-data patterns ---------------------------------------------
PII_PATTERNS = {
    "email": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+",
    "phone": r"(\+?\d[\d\s\-().]{7,}\d)",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d[ -]?){13,16}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}

# --- fixed values: stopwords per language, in order of preference ---------------------
STOPWORDS = {
    "en": ["the", "is", "at", "which", "on", "a", "an", "and", "or", "of", "to"],
    "es": ["el", "la", "los", "las", "es", "en", "y", "de", "del", "que"],
    "fr": ["le", "la", "les", "est", "et", "de", "du", "un", "une", "je"],
}

# --- fixed values: reading-ease formula -------------------------------------------------
FLESCH_BASE = 206.835
FLESCH_WORDS = 1.015
FLESCH_SYLLABLES = 84.6
VOWELS = "aeiouy"
