"""Column names, feature lists and fixed lookup values.

The values under "Fixed values" must equal the ones the original application
uses, so that results match; they are stated plainly and in their natural order.
"""

from __future__ import annotations

KEY = "location_id"
TIME = "valid_time"

# ---------------------------------------------------------------------------
# Fixed values (must match the original application)
# ---------------------------------------------------------------------------

# Physical validity bounds (inclusive), applied by clipping.
VALID_RANGES = {
    "temperature": (-20.0, 60.0),
    "surface_pressure": (850.0, 1080.0),
    "total_cloud_cover": (0.0, 1.0),
    "low_cloud_cover": (0.0, 1.0),
    "medium_cloud_cover": (0.0, 1.0),
    "high_cloud_cover": (0.0, 1.0),
    "precipitation": (0.0, 300.0),
    "humidity": (0.0, 100.0),
    "wind_speed": (0.0, 60.0),
}

# Raw reanalysis names (short and long forms) -> intermediate names.
RENAME_MAP = {
    "t2m": "temperature_raw",
    "sp": "surface_pressure_raw",
    "tcc": "total_cloud_cover",
    "lcc": "low_cloud_cover",
    "mcc": "medium_cloud_cover",
    "hcc": "high_cloud_cover",
    "tp": "precipitation_raw",
    "d2m": "dewpoint_raw",
    "u10": "u_wind",
    "v10": "v_wind",
    "2m_temperature": "temperature_raw",
    "surface_pressure": "surface_pressure_raw",
    "total_precipitation": "precipitation_raw",
    "2m_dewpoint_temperature": "dewpoint_raw",
    "10m_u_component_of_wind": "u_wind",
    "10m_v_component_of_wind": "v_wind",
}

# Clean series columns, in output order.
CLEAN_COLUMNS = [
    "valid_time",
    "temperature",
    "surface_pressure",
    "total_cloud_cover",
    "low_cloud_cover",
    "medium_cloud_cover",
    "high_cloud_cover",
    "precipitation",
    "humidity",
    "wind_speed",
]

# Columns a feature row must have non-null before training.
FEATURE_NOT_NULL = [
    "temperature",
    "surface_pressure",
    "total_cloud_cover",
    "low_cloud_cover",
    "medium_cloud_cover",
    "high_cloud_cover",
    "precipitation",
    "humidity",
    "wind_speed",
    "temp_rolling_6",
    "temp_lag_1",
    "temp_lag_24",
    "rain_tomorrow",
]

# Rain classifier inputs, in model order (13).
RAIN_FEATURES = [
    "temperature",
    "surface_pressure",
    "total_cloud_cover",
    "low_cloud_cover",
    "medium_cloud_cover",
    "high_cloud_cover",
    "precipitation",
    "humidity",
    "wind_speed",
    "temp_rolling_6",
    "temp_lag_1",
    "temp_lag_24",
    "month",
]

# Temperature forecaster inputs, in model order, target first (12).
FORECAST_FEATURES = [
    "temperature",
    "temp_lag_1",
    "temp_lag_24",
    "temp_rolling_6",
    "humidity",
    "surface_pressure",
    "total_cloud_cover",
    "wind_speed",
    "hour_sin",
    "hour_cos",
    "month_sin",
    "month_cos",
]
FORECAST_TARGET = "temperature"

# Defaults of the feature builders.
LAG_HOURS = [1, 24]
ROLLING_WINDOW = 6
RAIN_THRESHOLD_MM = 1.0
RAIN_LOOKAHEAD_H = 24
LOOKBACK = 24
FORECAST_N = 5
LOCAL_TZ = "Asia/Kolkata"

# Classifier hyper-parameters (boosted trees).
RAIN_TREES = 300
RAIN_DEPTH = 5
RAIN_LEARNING_RATE = 0.05
RAIN_SUBSAMPLE = 0.8
RAIN_COLSAMPLE = 0.8
RAIN_SEED = 42
EARLY_STOP_ROUNDS = 20
CV_FOLDS = 5

# Threshold sweep: 0.10, 0.15, ..., 0.90 (17 values), default 0.5.
SWEEP_START = 0.10
SWEEP_STEP = 0.05
SWEEP_COUNT = 17
DEFAULT_THRESHOLD = 0.5

# Confidence labels and their cut-offs.
CONF_HIGH_RAIN = "high (rain likely)"
CONF_MEDIUM = "medium"
CONF_HIGH_DRY = "high (no rain likely)"
CONF_LOW = "low (uncertain)"

# Weather code -> (description, icon); anything else is ("Unknown", "01d").
WEATHER_CODES = [
    (0, "Clear sky", "01d"),
    (1, "Mainly clear", "02d"),
    (2, "Partly cloudy", "03d"),
    (3, "Overcast", "04d"),
    (45, "Fog", "50d"),
    (48, "Depositing rime fog", "50d"),
    (51, "Light drizzle", "09d"),
    (53, "Moderate drizzle", "09d"),
    (55, "Dense drizzle", "09d"),
    (61, "Slight rain", "10d"),
    (63, "Moderate rain", "10d"),
    (65, "Heavy rain", "10d"),
    (71, "Slight snow", "13d"),
    (73, "Moderate snow", "13d"),
    (75, "Heavy snow", "13d"),
    (80, "Rain showers", "09d"),
    (95, "Thunderstorm", "11d"),
]
UNKNOWN_CODE = ("Unknown", "01d")

# Dashboard icon / text rules (precipitation mm, cloud percent).
ICON_STORM, ICON_RAIN, ICON_OVERCAST, ICON_PARTLY, ICON_CLEAR = "⛈️", "🌧️", "☁️", "⛅", "☀️"
DESC_STORM, DESC_RAIN, DESC_OVERCAST = "thunderstorm", "rain", "overcast"
DESC_MOSTLY, DESC_PARTLY, DESC_CLEAR = "mostly cloudy", "partly cloudy", "clear sky"

# Relative humidity (Magnus form) coefficients.
MAGNUS_A = 17.625
MAGNUS_B = 243.04
KELVIN_OFFSET = 273.15


def require_columns(df, required) -> None:
    """Raise ValueError naming the missing columns (checked by name only)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
