"""Fixed values and defaults.

Everything here is a value that must be equal to the service being
re-implemented for results to agree (feature lists, tiers, window sizes,
error codes, the holiday calendar, the market close).  They are stated
plainly and in their natural order.
"""

from __future__ import annotations

# --- fixed values: price features --------------------------------------------
# Lags (rows back) and trailing moving-average lengths (rows, current row included).
LAGS = (1, 5, 20, 100)
MOVING_AVERAGES = (5, 20, 100)

FEATURE_COLUMNS = ("lag1", "lag5", "lag20", "lag100", "ma5", "ma20", "ma100")
REQUIRED_COLUMNS = ("date", "price") + FEATURE_COLUMNS

# Horizon tiers: horizon <= 5 short, <= 20 medium, otherwise long.
SHORT_TERM_FEATURES = ("lag1", "lag5", "ma5", "ma20")
MEDIUM_TERM_FEATURES = ("lag5", "lag20", "ma20", "ma100")
LONG_TERM_FEATURES = ("lag20", "lag100", "ma100")
SHORT_TERM_MAX_HORIZON = 5
MEDIUM_TERM_MAX_HORIZON = 20
N_SLOTS = 4  # widest tier; the long tier fills the last slot with 0.0

# --- fixed values: training -------------------------------------------------
MIN_FEATURE_ROWS = 10          # fewer feature rows -> INSUFFICIENT_DATA
DEFAULT_TEST_SIZE = 0.2        # n_splits = max(2, int(1 / test_size))
TRAIN_LOOKBACK_DAYS = 3 * 365  # training window before "now"
FORECAST_HISTORY_DAYS = 180    # serving window before the latest date
SERVING_TAIL_ROWS = 100        # newest rows used to build serving features
MAX_HORIZON = 365              # library bound (the request surface used 120)
MAPE_EPSILON = 2.220446049250313e-16  # float64 machine epsilon, MAPE floor
MODEL_TYPE = "LinearRegression"
VERSION_KIND = "linear"        # version string: {ticker}_linear_{h}day_{yyyyMMddHHmmss}
MAX_TICKER_LENGTH = 10
FILES_BEFORE_SNAPSHOT = 64     # model files outside the snapshot that make a job write a new one

# --- fixed values: time -----------------------------------------------------
MARKET_TIMEZONE = "America/New_York"
MARKET_CLOSE_HOUR = 16
MARKET_CLOSE_MINUTE = 30

# --- fixed values: outcome codes --------------------------------------------
MODEL_NOT_FOUND = "MODEL_NOT_FOUND"
MODEL_CORRUPTED = "MODEL_CORRUPTED"
INSUFFICIENT_DATA = "INSUFFICIENT_DATA"
DATA_FETCH_FAILED = "DATA_FETCH_FAILED"
TRAINING_FAILED = "TRAINING_FAILED"
INVALID_REQUEST = "INVALID_REQUEST"
# outcome codes of this library alone
HORIZON_NOT_LISTED = "HORIZON_NOT_LISTED"   # valid, but the job was laid out for other horizons
DUPLICATE_DAYS = "DUPLICATE_DAYS"           # the price source has several rows for a day of the series

STATUS_COMPLETED = "completed"
STATUS_FAILED = "failed"
STATUS_SKIPPED = "skipped"

# --- fixed values: US federal holidays (country calendar "US") ---------------
# Fixed-date holidays: (name, month, day, first_year, last_year or None).
# A fixed-date holiday on a Saturday is observed the Friday before, on a
# Sunday the Monday after (New Year's Day on a Saturday -> Friday Dec 31).
FIXED_DATE_HOLIDAYS = (
    ("New Year's Day", 1, 1, 1871, None),
    ("Washington's Birthday", 2, 22, 1879, 1970),
    ("Memorial Day", 5, 30, 1888, 1970),
    ("Juneteenth National Independence Day", 6, 19, 2021, None),
    ("Independence Day", 7, 4, 1871, None),
    ("Columbus Day", 10, 12, 1937, 1970),
    ("Veterans Day", 11, 11, 1938, 1970),
    ("Veterans Day", 11, 11, 1978, None),
    ("Christmas Day", 12, 25, 1871, None),
)
# Floating holidays: (name, month, weekday Mon=0..Sun=6, nth (-1 = last), first_year, last_year or None).
FLOATING_HOLIDAYS = (
    ("Martin Luther King Jr. Day", 1, 0, 3, 1986, None),
    ("Washington's Birthday", 2, 0, 3, 1971, None),
    ("Memorial Day", 5, 0, -1, 1971, None),
    ("Labor Day", 9, 0, 1, 1894, None),
    ("Columbus Day", 10, 0, 2, 1971, None),
    ("Veterans Day", 10, 0, 4, 1971, 1977),
    ("Thanksgiving Day", 11, 3, 4, 1942, None),
)
