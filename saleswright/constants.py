"""Fixed values of the domain. They must equal the established ones for results to match."""

# Lag offsets and rolling windows of the feature matrix (the horizon replaces the last).
LAGS = (1, 7, 14, 28, 90)
WINDOWS = (7, 14, 28, 90)
DEFAULT_HORIZON = 90

# Forecast horizons a request may ask for, size of a request batch, model inputs.
HORIZONS = (15, 30, 60, 90)
MAX_BATCH = 100
N_FEATURES = 27
MAX_STORE = 54

# Numeric model inputs in vector order, then the two categorical ones.
NUMERIC_FEATURES = (
    "year",
    "month",
    "day",
    "dayofweek",
    "dayofyear",
    "is_mid_month",
    "is_leap_year",
    "oil_price",
    "is_holiday",
    "onpromotion",
    "promo_rolling_7",
    "cluster",
    "sales_lag_1",
    "sales_lag_7",
    "sales_lag_14",
    "sales_lag_28",
    "sales_lag_90",
    "sales_rolling_mean_7",
    "sales_rolling_mean_14",
    "sales_rolling_mean_28",
    "sales_rolling_mean_90",
    "sales_rolling_std_7",
    "sales_rolling_std_14",
    "sales_rolling_std_28",
    "sales_rolling_std_90",
)
CATEGORICAL_FEATURES = ("family", "type")
ENCODED_FEATURES = ("family_encoded", "type_encoded")

# The product families a request may name.
FAMILIES = (
    "AUTOMOTIVE",
    "BABY CARE",
    "BEAUTY",
    "BEVERAGES",
    "BOOKS",
    "BREAD/BAKERY",
    "CELEBRATION",
    "CLEANING",
    "DAIRY",
    "DELI",
    "EGGS",
    "FROZEN FOODS",
    "GROCERY I",
    "GROCERY II",
    "HARDWARE",
    "HOME AND KITCHEN I",
    "HOME AND KITCHEN II",
    "HOME APPLIANCES",
    "HOME CARE",
    "LADIESWEAR",
    "LAWN AND GARDEN",
    "LINGERIE",
    "LIQUOR,WINE,BEER",
    "MAGAZINES",
    "MEATS",
    "PERSONAL CARE",
    "PET SUPPLIES",
    "PLAYERS AND ELECTRONICS",
    "POULTRY",
    "PREPARED FOODS",
    "PRODUCE",
    "SCHOOL AND OFFICE SUPPLIES",
    "SEAFOOD",
)

# Upper bounds of the request-latency and batch-size histograms.
LATENCY_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
BATCH_SIZE_BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0)

# Residual percentiles behind the 80 % and 95 % bands, and normal quantiles per level.
BAND_PERCENTILES = {
    "lower_80_offset": 0.10,
    "upper_80_offset": 0.90,
    "lower_95_offset": 0.025,
    "upper_95_offset": 0.975,
}
LEVEL_Z = {80: 1.2815515655446004, 95: 1.959963984540054}

TOTAL, STORE, FAMILY, BOTTOM = "Total", "Store", "Family", "Bottom"
