"""Fixed values of the exposure model.

They must equal the published numbers for results to agree, so they stand here
plainly and in order; nothing else in the package repeats them.
"""

# Column-weight coefficients: intercept, then the seven features in FEATURES order.
THETA = (
    25.345046, -0.982964, -0.674570, -0.674570,
    -0.300289, 0.077756, -12.066771, 1.449352,
)
FEATURES = (
    "log_dte", "log_gmag", "net_col_sign_log", "askbid_imbalance",
    "doi_migration", "com_dist_rel", "tod_frac",
)

LAMBDA_BATCH = 0.79       # decay of the cross-expiry weight per batch
LAMBDA_CELL = 0.99        # decay of the per-cell state per median cadence
CADENCE_S = 241.0         # median seconds between batches
BATCH_INTERVAL_S = 482.0  # two cadences: staleness and gap limit
MAG_GAMMA = 0.7           # magnitude exponent of the column weight
SHAPE_P = 1.25            # within-column power

# State-model coefficients in the order g, q_g, f, q_f, g*rho, deliver, reject, touch.
STATE_BETA = (
    0.791887839, -0.258052945, -0.000170497, -0.000108827,
    -0.553463898, -3.517e-06, -1.216e-06, -1.7323e-05,
)

EWMA_SLOW = 0.9
EWMA_FAST = 0.5

KING_TOL_INDEX = 25.0     # strike tolerance for the large index
KING_TOL_OTHER = 5.0
INDEX_SYMBOLS = ("SPX",)  # symbols with the wide tolerance
MATERIAL_FRAC = 0.05      # nodes at or above this share of max |V| are scored
NEAR_TIE = 0.9

# Unusual-activity defaults.
MIN_RVOL = 2.0
RVOL_DAYS = 10
MIN_AVG_VOLUME = 100.0
MIN_OI_CHANGE = 500.0
MIN_OI_CHANGE_PCT = 25.0
SURPRISE_PCTILE = 0.90
SURPRISE_DAYS = 20

SCALE_SUFFIX = {"": 1.0, "K": 1e3, "M": 1e6, "B": 1e9}
TIME_COLUMNS = ("t", "date", "ts", "created", "last_trade")
SCORE_FEATURES = (
    "premium", "volume", "vol_oi", "oi_change_pct", "ask_share",
    "prem_vs_base", "rvol", "n_strikes",
)
UNUSUAL_FEATURES = ("vol_oi", "oi_change_pct", "rvol", "prem_vs_base", "ask_share")
LAMBDA_GRID = (0.0, 0.5, 0.9, 0.95, 0.98, 0.99, 0.995)
