"""Schemas and fixed values.

FIXED VALUES: the word lists, names, thresholds and limits below must equal
the ones of the pipeline this library reproduces, so that flags, tactics,
tiers and verdicts come out the same. They are written out as data, in
their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Canonical message table
# ---------------------------------------------------------------------------

# FIXED VALUES: canonical column order.
CANONICAL_COLUMNS = [
    "message_id", "raw_text", "clean_text", "channel", "language",
    "sender_id", "receiver_id", "sender_role", "timestamp",
    "attack_label", "manipulation_tactic", "intent_stage",
    "source_dataset", "confidence_label",
]

CANONICAL_SCHEMA = T.StructType([
    T.StructField("message_id", T.StringType(), False),
    T.StructField("raw_text", T.StringType(), True),
    T.StructField("clean_text", T.StringType(), True),
    T.StructField("channel", T.StringType(), True),
    T.StructField("language", T.StringType(), True),
    T.StructField("sender_id", T.StringType(), True),
    T.StructField("receiver_id", T.StringType(), True),
    T.StructField("sender_role", T.StringType(), True),
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("attack_label", T.StringType(), True),
    T.StructField("manipulation_tactic", T.StringType(), True),
    T.StructField("intent_stage", T.StringType(), True),
    T.StructField("source_dataset", T.StringType(), True),
    T.StructField("confidence_label", T.StringType(), True),
])

# FIXED VALUES: fields that must never be null in a source of the corpus.
REQUIRED_FIELDS = ["clean_text", "attack_label", "channel"]

# FIXED VALUES: source names.
SOURCE_SMS = "uci_sms"
SOURCE_MAIL = "enron"
SOURCE_PHISHING = "nazario_phishing"

MALICIOUS_LABELS = ["smishing", "phishing"]

# ---------------------------------------------------------------------------
# Raw source schemas
# ---------------------------------------------------------------------------

MAIL_CSV_SCHEMA = T.StructType([
    T.StructField("file", T.StringType(), True),
    T.StructField("message", T.StringType(), True),
])

MAIL_CSV_NAMED_SCHEMA = T.StructType([
    T.StructField("file_path", T.StringType(), True),
    T.StructField("raw_message", T.StringType(), True),
])

PHISHING_CSV_SCHEMA = T.StructType([
    T.StructField("sender", T.StringType(), True),
    T.StructField("receiver", T.StringType(), True),
    T.StructField("date", T.StringType(), True),
    T.StructField("subject", T.StringType(), True),
    T.StructField("body", T.StringType(), True),
    T.StructField("label", T.IntegerType(), True),
])

AUDIT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType(), True),
    T.StructField("probability", T.DoubleType(), True),
    T.StructField("risk_tier", T.StringType(), True),
    T.StructField("is_malicious", T.BooleanType(), True),
    T.StructField("mode", T.StringType(), True),
    T.StructField("channel", T.StringType(), True),
    T.StructField("text_length", T.IntegerType(), True),
])

PREDICTIONS_SCHEMA = T.StructType([
    T.StructField("true_label", T.IntegerType(), True),
    T.StructField("pred_label", T.IntegerType(), True),
    T.StructField("prob_malicious", T.DoubleType(), True),
])

# ---------------------------------------------------------------------------
# Keyword dictionaries (substring matches on lower-cased text)
# ---------------------------------------------------------------------------

# FIXED VALUES: SMS tactic keywords; checked in this order, first hit wins.
SMS_TACTICS = [
    ("urgency", ["urgent", "now", "immediately", "claim", "hurry", "fast", "quick", "asap", "expire"]),
    ("fear", ["alert", "suspended", "problem", "blocked", "warning", "security", "verify", "confirm"]),
    ("reward", ["free", "win", "prize", "cash", "winner", "congratulations", "award", "bonus", "gift"]),
]
SMS_TACTIC_DEFAULT = "none"

# FIXED VALUES: phishing-mail tactic keywords.
MAIL_TACTIC_KEYWORDS = {
    "urgency": [
        "urgent", "immediately", "now", "asap", "expire", "deadline",
        "hurry", "limited time", "act now", "within 24", "within 48",
        "suspend", "suspended", "terminated", "closing",
    ],
    "authority": [
        "bank", "paypal", "ebay", "amazon", "irs", "government",
        "official", "administrator", "support team", "security team",
        "account manager", "compliance", "legal", "federal",
    ],
    "fear": [
        "alert", "warning", "problem", "blocked", "unauthorized",
        "suspicious", "fraud", "stolen", "hacked", "compromised",
        "locked", "disabled", "restricted", "violation",
    ],
    "reward": [
        "free", "win", "winner", "prize", "cash", "reward", "bonus",
        "gift", "lottery", "inheritance", "million", "congratulations",
    ],
}
# FIXED VALUES: priority order of the mail tactics.
MAIL_TACTIC_ORDER = ["authority", "urgency", "fear", "reward"]
MAIL_TACTIC_DEFAULT = "unknown"

# FIXED VALUES: hard-negative risk wording.
AUTHORITY_KEYWORDS = [
    "bank", "account", "verify", "verification", "payment", "invoice",
    "paypal", "security", "confirm", "password", "update your", "login",
    "suspend", "billing", "transaction", "credit card", "debit",
]
URGENCY_KEYWORDS = [
    "urgent", "immediately", "deadline", "action required", "act now",
    "expires", "limited time", "asap", "right away", "final notice",
    "last chance", "respond now", "within 24", "within 48",
]

# FIXED VALUES: header names whose residual lines are removed from mail
# bodies ("x-" stands for every header starting with x-).
RESIDUAL_HEADERS = [
    "mime-version", "content-type", "content-transfer-encoding", "x-.*",
    "message-id", "date", "from", "to", "subject", "cc", "bcc",
]

# FIXED VALUES: texts that a pandas CSV re-read turns into missing values.
NA_SENTINELS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# ---------------------------------------------------------------------------
# Scoring constants
# ---------------------------------------------------------------------------

# FIXED VALUES: risk tier upper bounds (score < bound) in order.
RISK_TIERS = [(0.2, "Low"), (0.5, "Medium"), (0.8, "High")]
RISK_TIER_TOP = "Critical"

# FIXED VALUES: decision threshold per security mode.
MODE_THRESHOLDS = {"balanced": 0.95, "high_recall": 0.50, "low_fp": 0.95}
DEFAULT_MODE = "balanced"
CHANNELS = ["email", "sms", "unknown"]

# FIXED VALUES: ensemble weights and the tolerance of their sum.
DEFAULT_FIRST_WEIGHT = 0.4   # linear TF-IDF model
DEFAULT_SECOND_WEIGHT = 0.6  # contextual second model
WEIGHT_TOLERANCE = 0.001

# FIXED VALUES: input limits.
MAX_CHAR_LENGTH = 10000      # characters kept when scoring
MAX_REQUEST_CHARS = 50000    # longest accepted request text
MAX_BATCH = 100              # messages per batch request
SECOND_MODEL_MAX_TOKENS = 256

# FIXED VALUES: modelling defaults.
TEST_SIZE = 0.2
RANDOM_STATE = 42
VOCAB_SIZE_V1 = 20000
VOCAB_SIZE_V2 = 30000
MIN_DF = 2
MAX_DF = 0.95
SAMPLE_SIZE_MAIL = 50000
SAMPLES_PER_CATEGORY = 20

# FIXED VALUES: thresholds listed in the threshold table (hundredths).
THRESHOLD_TABLE_STEPS = [1, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90]
