"""Fixed values of the vetting domain.  They are contracts, not tunables: the
numbers below decide which rows match, which bins exist and which columns a
ranker may see, so every operator takes them from here."""

# --- cadence, gaps and grouping tolerances (days) ---------------------------
CADENCE_DAYS = 30.0 / 1440.0
GAP_BREAK_DAYS = 0.5
CHUNK_BREAK_DAYS = 0.75
SPAN_BREAK_DAYS = 20.0
SPAN_PAD_DAYS = 2.0
SPAN_GRID_PER_DAY = 10.0
DUPLICATE_TOLERANCE_DAYS = 0.0209

# --- event windows and views ------------------------------------------------
LOCAL_BINS = 201
LOCAL_HALF_DURATIONS = 3.0
LOCAL_HALF_MIN_DAYS = 0.75
RECUR_BINS = 64
RECUR_WINDOW_DURATIONS = 1.5
SIDEBAND_OUTER_DURATIONS = 3.0
SIDEBAND_MIN_POINTS = 5
CYCLE_CAP = 60
MAD_TO_SIGMA = 1.4826
SCATTER_MIN_POINTS = 5
SCATTER_FLOOR = 1e-6

# --- noise screen -----------------------------------------------------------
NOISE_MASK_WIDTHS = 1.6
NOISE_DEFAULT_WIDTH = 0.02
NOISE_MIN_POINTS = 200
NOISE_MIN_CHUNK = 24

# --- operating points -------------------------------------------------------
MIN_SNR = 5.0
MAX_DURATION_DAYS = 1.0
DETREND_WINDOWS = 21
DETREND_ROBUST_ABOVE = 18
STRATUM = (0.0015, 0.0030)

# --- host physics -----------------------------------------------------------
MASS_FRACTION = 0.3
ECCENTRICITY_CAP = 0.95
AXIS_FIT_MAX_ECC = 0.8

# --- pairs ------------------------------------------------------------------
PAIR_MIN_DAYS = 0.15
PAIR_MAX_PERIODS = 0.5
PAIR_RATE = 0.37
INVERT_RATE = 0.5
SELF_EXCLUSION_DAYS = 1e-9

# Twelve observed conjunctions: binary period, planet period, spacing (days).
OBSERVED_SPACINGS = [
    (41.079, 229.0, 8.174), (41.079, 229.0, 8.400), (41.079, 229.0, 8.200),
    (41.079, 229.0, 8.340), (41.079, 229.0, 8.220), (27.796, 289.0, 5.558),
    (27.796, 289.0, 7.377), (27.796, 289.0, 3.270), (27.796, 289.0, 4.659),
    (20.734, 131.0, 4.440), (20.734, 131.0, 1.920), (11.259, 1108.0, 4.312),
]
SPACING_KERNEL_DEX = 0.3
SPACING_JITTER = 0.05
DEPTH_RATIO_JITTER = 0.20
DEPTH_RATIO_CLIP = (1e-3, 2.0)
DURATION_RATIO_JITTER = 0.15
DURATION_RATIO_CLIP = (0.02, 1.0)

# 40 mid-quantiles of the partner/lead depth factor.
DEPTH_FACTOR_QUANTILES = [
    0.00400, 0.01315, 0.04099, 0.07419, 0.10334, 0.16359, 0.20757, 0.27405,
    0.31708, 0.36809, 0.39552, 0.42518, 0.46267, 0.49589, 0.51653, 0.54358,
    0.56443, 0.59403, 0.61384, 0.63110, 0.64975, 0.66376, 0.68154, 0.69921,
    0.71971, 0.73787, 0.74996, 0.76214, 0.77678, 0.78662, 0.80130, 0.81813,
    0.83766, 0.85812, 0.87676, 0.89130, 0.90416, 0.94344, 1.32256, 11.23515,
]
# 25 quantiles of the partner/lead duration ratio.
DURATION_RATIO_QUANTILES = [
    0.01798, 0.02474, 0.03573, 0.05006, 0.05469, 0.06354, 0.06819, 0.07885,
    0.08959, 0.09110, 0.09910, 0.10976, 0.11563, 0.13493, 0.15785, 0.17445,
    0.20756, 0.22383, 0.25460, 0.26722, 0.30855, 0.32602, 0.36188, 0.43093,
    0.83925,
]

# --- epoch histogram --------------------------------------------------------
PHASE_BINS = 10
PHASE_MAX = 0.5
GAP_EDGES = [0.0, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 30.0]
EPOCH_TRIES = 20

# --- incumbent block --------------------------------------------------------
BEST_FIT_CLASSES = ["T", "AT", "Sin", "ASin", "L", "AL", "St", "ASt", "A"]
MODEL_KINDS = ["transit", "sinusoidal", "linear", "step"]
AIC_COLUMNS = [f"aic_{k}" for k in MODEL_KINDS]
RMSE_COLUMNS = [f"rmse_{k}" for k in MODEL_KINDS]
INCUMBENT_COLUMNS = (
    [f"delta_{c}" for c in AIC_COLUMNS] + RMSE_COLUMNS
    + [f"best_fit_{c}" for c in BEST_FIT_CLASSES]
)

# --- record schema ----------------------------------------------------------
CORE_SCALARS = [
    "snr", "depth", "t_dur", "log_p_bin", "morph_coeff", "tmag", "sin_phase",
    "cos_phase", "detrend_fraction", "skye_flag", "gap_proximity",
    "local_scatter", "log1p_n_cycles", "rec_depth_med", "rec_depth_mad",
    "rec_frac_dipping",
]
HOST_SCALARS = ["same_star_multi_allowed", "log10_pp_over_pbin"]
PAIR_SCALARS = [
    "has_observed_pair", "pair_dt_over_pbin",
    "pairing_depth_ratio_vs_expectation", "pair_duration_ratio",
]
CONDITIONAL_SCALARS = ["skye_flag", "morph_coeff", "tmag"] + PAIR_SCALARS
WITHHELD_SCALARS = ["gap_proximity", "skye_flag"]
AUDIT_COLUMNS = [
    "truth_pair_role", "truth_partner_dt", "truth_partner_ratio",
    "pair_model_version", "source_dir", "rebalance_keep", "split", "event_key",
    "label", "label_source", "inverted_lc", "incumbent_valid", "n_cycles_raw",
]
LABEL_SOURCES = ["real_search", "bank_injection", "elc_injection"]
SHORTLIST_COLUMNS = [
    "tic", "sector", "event_time", "phase", "depth", "duration", "snr",
    "n_detrend_detections", "skye_flag", "best_fit_label", "arm_b_score",
    "rank", "coverage_tier", "sector_overlap_frozen", "disposition",
]
EIGHT_FEATURES = ["depth", "duration", "snr", "sin_phase", "cos_phase",
                  "log_p_bin", "morph_coeff", "tmag"]

# --- splits and gates -------------------------------------------------------
SPLITS = ["train", "val", "test"]
SPLIT_TARGETS = [0.70, 0.15, 0.15]
SPLIT_TARGETS_HIGH = [0.60, 0.15, 0.25]
TIER_EDGES = (3, 10)
GATE_INVERSION_DELTA = 0.05
GATE_AUC = 0.55
GATE_MIX = 0.02
MDE_Z = 2.80
PROBE_MIN_FINITE = 50
POSITIVES_PER_NEGATIVE = 3.0

# --- pair-host screen and expected yield ------------------------------------
REFERENCE_DEPTH = 0.005
SCREEN_RATIO = 0.33
SCREEN_SNR = 5.0
CADENCES_PER_TRANSIT = 12.0
YIELD_SIGMA = [1e-4, 1e-3, 3e-3, 1e-2, 3e-2]
YIELD_FRACTION = [0.445, 0.367, 0.326, 0.261, 0.181]
YIELD_DUTY = 0.8
YIELD_ATTRITION = 0.85
YIELD_FLOOR = 30
YIELD_RECOVERY = (0.41, 0.12, 0.05, 0.95)

# --- census -----------------------------------------------------------------
IMPACT_MAX = 1.0
CROSSING_MIN_DAYS = 1e-4
MAX_PLANET_DEPTH = 0.05
CENSUS_RATE_TRIP = 0.10
CENSUS_KS_P = 0.01
CENSUS_SPACING_TRIP = 0.20
CENSUS_RATIO_TRIP = 0.30

# --- injection design -------------------------------------------------------
DESIGN_DEPTH = (1.0e-3, 1.5e-2)
DESIGN_DURATION = (0.05, 1.0)
DESIGN_IMPACT = (0.0, 0.9)
DESIGN_LIMB1 = (0.2, 0.5)
DESIGN_LIMB2 = (0.1, 0.3)
DESIGN_WARP_FRACTION = 0.30
DESIGN_WARP = (0.1, 0.3)
INJECTION_CURVATURE = 0.35

# --- review queue -----------------------------------------------------------
# Events and files of the inverted search that a queue's rate is held against.
QUEUE_EVENTS, QUEUE_FILES = 7176, 3808
