"""Target order, holidays, weights and model defaults."""

# Target columns in scoring order. The order matters: the correlation
# correction walks the targets one after the other.
TARGETS = ("choc", "beer", "hair", "rice")

# Product category behind each target column.
TARGET_CATEGORIES = {
    "choc": "チョコレート",
    "beer": "ビール",
    "hair": "ヘアケア",
    "rice": "米（5㎏以下）",
}

# Japanese public holidays, 2023 and 2024.
HOLIDAYS_2023 = (
    "2023-01-01", "2023-01-02", "2023-01-09", "2023-02-11", "2023-02-23",
    "2023-03-21", "2023-04-29", "2023-05-03", "2023-05-04", "2023-05-05",
    "2023-07-17", "2023-08-11", "2023-09-18", "2023-09-23", "2023-10-09",
    "2023-11-03", "2023-11-23", "2023-12-23",
)
HOLIDAYS_2024 = (
    "2024-01-01", "2024-01-08", "2024-02-11", "2024-02-12", "2024-02-23",
    "2024-03-20", "2024-04-29", "2024-05-03", "2024-05-04", "2024-05-05",
    "2024-05-06", "2024-07-15", "2024-08-11", "2024-08-12", "2024-09-16",
    "2024-09-22", "2024-09-23", "2024-10-14", "2024-11-03", "2024-11-04",
    "2024-11-23",
)
# The list used without the weekend rule has one more day in 2024.
HOLIDAYS_ALL = HOLIDAYS_2023 + HOLIDAYS_2024 + ("2024-12-23",)

# Time-of-day bands, closed on the right; hour 0 has no band.
TIME_BANDS = ((6, "深夜"), (11, "午前"), (14, "昼"), (17, "午後"), (21, "夕方"), (24, "夜"))

# Pseudo-count of the prior, per target.
DEFAULT_CONFIDENCE = {"choc": 10.0, "beer": 10.0, "hair": 10.0, "rice": 10.0}
PRODUCTION_CONFIDENCE = {"choc": 15.3, "beer": 8.7, "hair": 12.1, "rice": 6.4}

# Exponential decay per day, per target.
DECAY_RATES = {"choc": 0.015, "beer": 0.025, "hair": 0.04, "rice": 0.008}

# Blend weights per target.
BLEND_WEIGHTS = {
    "choc": {"bayes": 0.75, "segment": 0.10, "weekday": 0.04, "band": 0.04,
             "phase": 0.02, "store": 0.03, "sequence": 0.02},
    "beer": {"bayes": 0.80, "segment": 0.07, "weekday": 0.04, "band": 0.04,
             "phase": 0.02, "store": 0.01, "sequence": 0.02},
    "hair": {"bayes": 0.60, "segment": 0.20, "weekday": 0.04, "band": 0.04,
             "phase": 0.02, "store": 0.08, "sequence": 0.02},
    "rice": {"bayes": 0.65, "segment": 0.15, "weekday": 0.04, "band": 0.02,
             "phase": 0.04, "store": 0.08, "sequence": 0.02},
}

# Strength of the pull from other targets, per target.
CORRELATION_STRENGTH = {"choc": 0.18, "beer": 0.05, "hair": 0.12, "rice": 0.15}
# Fixed values: (from, to) pairs with a strength of their own.
CORRELATION_PAIRS = {
    ("beer", "choc"): 0.15,
    ("choc", "beer"): 0.10,
    ("choc", "hair"): 0.12,
    ("choc", "rice"): 0.08,
}

# Attribute triple, model sizes and thresholds.
ATTRIBUTES = ("age_band", "gender", "store")
ERROR_STRENGTH_VALIDATION = 0.5
ERROR_STRENGTH_PRODUCTION = 0.7
SEQUENCE_SUPPORT = 5
SEQUENCE_LENGTH = 5
RANDOM_CUT = 0.3
EMBED_DIM = 32
FOLDS = 4
TOP_CATEGORIES = 100
CLASS_WEIGHT_CAP = 15.0
MODEL_BLEND = (0.6, 0.4)
NEVER = 999
SINGLE_PURCHASE_GAP = 30
