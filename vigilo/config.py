"""Fixed values of the reference pipeline.

Column lists, tokens, alias map and thresholds below must equal the
reference's for its results to be reproduced; they are stated here once,
in their natural order, and imported everywhere else.
"""

# ---- fixed values: report columns read by name -------------------------------
REPORT_COLUMNS = [
    "VAERS_ID", "AGE_YRS", "SEX", "STATE", "NUMDAYS", "HOSPDAYS",
    "HOSPITAL", "L_THREAT", "ER_ED_VISIT", "DISABLE", "RECOVD",
    "X_STAY", "BIRTH_DEFECT", "OFC_VISIT", "V_ADMINBY",
    "RECVDATE", "DIED",
]
SYMPTOM_COLUMNS = ["VAERS_ID", "SYMPTOM1", "SYMPTOM2", "SYMPTOM3", "SYMPTOM4", "SYMPTOM5"]
SYMPTOM_SLOTS = SYMPTOM_COLUMNS[1:]
VACCINE_COLUMNS = ["VAERS_ID", "VAX_MANU", "VAX_DOSE_SERIES", "VAX_ROUTE", "VAX_SITE"]

# ---- fixed values: feature groups -------------------------------------------
BIN_COLS = [
    "HOSPITAL", "L_THREAT", "ER_ED_VISIT", "DISABLE",
    "RECOVD", "X_STAY", "BIRTH_DEFECT", "OFC_VISIT",
]
NUM_FEATURES = ["AGE_YRS", "NUMDAYS", "HOSPDAYS"]
CAT_FEATURES = ["SEX", "V_ADMINBY", "VAX_MANU", "VAX_DOSE_SERIES", "VAX_ROUTE", "VAX_SITE"]
CLIPPED = ["NUMDAYS", "HOSPDAYS"]
CLIP_LOW, CLIP_HIGH = 0.0, 365.0
LABEL = "DIED"
KEY = "VAERS_ID"
SYM_PREFIX = "SYM_"

# ---- fixed values: correlation heat-map columns --------------------------------
HEAT_COLS = [
    "AGE_YRS", "NUMDAYS", "HOSPDAYS",
    "HOSPITAL", "L_THREAT", "ER_ED_VISIT", "DISABLE",
    "RECOVD", "X_STAY", "BIRTH_DEFECT", "OFC_VISIT", "DIED",
]

# ---- fixed values: clinical outcomes of the age box view, with display names --
OUTCOME_LABELS = [
    ("HOSPITAL", "Hospitalised"),
    ("L_THREAT", "Life-Threatening"),
    ("ER_ED_VISIT", "ER Visit"),
    ("DISABLE", "Disability"),
    ("DIED", "Died"),
]

# ---- fixed values: explorer feature groups and their type captions -----------
EXPLORER_NUM = ["AGE_YRS", "NUMDAYS", "HOSPDAYS"]
EXPLORER_CAT = ["SEX", "VAX_MANU", "VAX_DOSE_SERIES", "VAX_ROUTE", "VAX_SITE", "STATE"]
EXPLORER_BIN = BIN_COLS
EXPLORER_KINDS = {
    "num": "Numerical (continuous)",
    "cat": "Categorical",
    "bin": "Binary (Yes/No outcome)",
    "sym": "Binary symptom flag",
}

# ---- fixed values: characters replaced by "_" in symptom column names ---------
SAFE_NAME_CHARS = [" ", "/", ",", "(", ")", "-", "'"]

# ---- fixed values: manufacturer aliases (applied after upper + strip) ----------
MANUFACTURER_ALIASES = {
    "PFIZER\\BIONTECH": "PFIZER",
    "PFIZER-BIONTECH": "PFIZER",
    "PFIZER\\BIONTECH ": "PFIZER",
}
MANUFACTURER_MISSING = "UNKNOWN"
CATEGORY_MISSING = "Unknown"

# ---- fixed values: text read as missing by the reference's CSV reader ----------
# (the default missing-value tokens of pandas.read_csv)
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# ---- fixed values: model display names ------------------------------------------
MODEL_LABELS = {
    "logistic": "Logistic Regression (Linear)",
    "ridge": "Ridge (L2 Logistic)",
    "lasso": "LASSO (L1 Logistic)",
    "cart": "CART (Decision Tree)",
    "random_forest": "Random Forest",
    "lightgbm": "LightGBM",
    "mlp": "MLP Neural Network (PyTorch)",
}

# ---- fixed values: sampling, splitting and thresholds ----------------------------
SEED = 42
SAMPLE_TARGET = 150_000
TEST_SHARE = 0.30
CV_FOLDS = 5
FOREST_CV_FOLDS = 3
VALIDATION_SHARE = 0.20
EXPLAIN_ROWS = 2000
TOP_TERMS = 30
TOP_VALUES = 5
DECISION_THRESHOLD = 0.5
ZERO_COEF_EPS = 1e-6
RISK_RATIO_FLOOR = 0.001
MONTHS_SHOWN = 42
AGE_BINS = 60
MIN_SUPPORT = {"SEX": 50, "VAX_MANU": 100, "VAX_DOSE_SERIES": 100, "STATE": 20, "category": 20}
PROB_CLIP = 1e-15
GRID_POINTS = 50
GRID_LOW_Q, GRID_HIGH_Q = 0.01, 0.99
TOP_FEATURES = 20
WATERFALL_ROWS = 15
WHATIF_WATERFALL_ROWS = 12
FLAG_TOTALS_TOP = 15

# ---- fixed values: model settings of the reference --------------------------------
LOGISTIC_MAX_ITER = 2000
PENALTY_C = 0.1
CART_DEPTH = 8
FOREST_TREES, FOREST_DEPTH = 200, 12
BOOST_ROUNDS = 300
CART_GRID = {"max_depth": [3, 5, 7, 10], "min_samples_leaf": [5, 10, 20, 50]}
FOREST_GRID = {"n_estimators": [50, 100, 200], "max_depth": [5, 8, 12]}
BOOST_GRID = {"n_estimators": [100, 200, 300], "max_depth": [3, 5, 7], "learning_rate": [0.05, 0.1]}
MLP_HIDDEN = [128, 128]
MLP_PATIENCE = 10
