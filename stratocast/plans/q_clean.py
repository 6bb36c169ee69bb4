"""Queries: projections, unit conversions, quality checks and filters (PRJ, QC, FLT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import units
from ..operators import quality
from ..schema import FEATURE_NOT_NULL, KEY, RAIN_FEATURES, TIME
from ..sources.tables import STANDIN_RAIN_THRESHOLD, clean_table, load, obs_table, raw_grid
from . import sqlparts as S
from .catalog import query, r6
from .clean import clean_raw, clean_series
from .features import build_features


def raw(spark, sf_dir):
    return raw_grid(load(spark, sf_dir, "events"))


def renamed(spark, sf_dir):
    return quality.rename_known(raw(spark, sf_dir))


def obs(spark, sf_dir):
    return obs_table(spark, sf_dir)


RAW = S.with_(S.RAW)
OBS = S.with_(S.OBS)
CLEAN = S.with_(S.OBS, S.CLEAN)
FEAT = S.with_(S.OBS, S.feat(STANDIN_RAIN_THRESHOLD))


@query(
    "prj_rename",
    RAW
    + """SELECT event_id, valid_time, latitude, longitude, t2m AS temperature_raw, d2m AS dewpoint_raw,
       sp AS surface_pressure_raw, tp AS precipitation_raw, u10 AS u_wind, v10 AS v_wind,
       tcc AS total_cloud_cover, lcc AS low_cloud_cover, mcc AS medium_cloud_cover, hcc AS high_cloud_cover
FROM raw""",
)
def q_prj_rename(spark, sf_dir):
    return renamed(spark, sf_dir)


@query(
    "prj_utc_to_local",
    RAW + "SELECT event_id, valid_time + INTERVAL 330 MINUTE AS valid_time FROM raw",
)
def q_prj_utc_to_local(spark, sf_dir):
    return quality.parse_datetime(renamed(spark, sf_dir)).select("event_id", TIME)


@query("prj_kelvin", RAW + f"SELECT event_id, {S.bround('t2m - 273.15', 4)} AS temperature FROM raw")
def q_prj_kelvin(spark, sf_dir):
    return quality.convert_units(renamed(spark, sf_dir)).select("event_id", "temperature")


@query("prj_pressure", RAW + f"SELECT event_id, {S.bround('sp / 100', 2)} AS surface_pressure FROM raw")
def q_prj_pressure(spark, sf_dir):
    return quality.convert_units(renamed(spark, sf_dir)).select("event_id", "surface_pressure")


@query(
    "prj_precip_mm",
    RAW
    + f"SELECT event_id, CASE WHEN {S.bround('tp * 1000', 4)} < 0 THEN 0.0::DOUBLE "
    f"ELSE {S.bround('tp * 1000', 4)} END AS precipitation FROM raw",
)
def q_prj_precip(spark, sf_dir):
    return quality.convert_units(renamed(spark, sf_dir)).select("event_id", "precipitation")


_T = S.bround("t2m - 273.15", 4)
_TD = S.bround("d2m - 273.15", 4)
_RH = f"100 * exp(17.625 * ({_TD}) / (243.04 + ({_TD}))) / exp(17.625 * ({_T}) / (243.04 + ({_T})))"


@query(
    "prj_humidity",
    RAW
    + f"""SELECT event_id, {S.bround(f"CASE WHEN ({_RH}) < 0 THEN 0.0 WHEN ({_RH}) > 100 THEN 100.0 ELSE ({_RH}) END", 2)}
       AS humidity FROM raw""",
)
def q_prj_humidity(spark, sf_dir):
    return quality.convert_units(renamed(spark, sf_dir)).select("event_id", "humidity")


@query("prj_wind", RAW + f"SELECT event_id, {S.bround('sqrt(u10 * u10 + v10 * v10)', 4)} AS wind_speed FROM raw")
def q_prj_wind(spark, sf_dir):
    return quality.convert_units(renamed(spark, sf_dir)).select("event_id", "wind_speed")


@query(
    "prj_cloud_fraction",
    RAW
    + f"""SELECT event_id, tcc * 100 AS cloud_cover_pct,
       {S.bround('(tcc * 100) / 100', 4)} AS cloud_cover_fraction FROM raw""",
)
def q_prj_cloud(spark, sf_dir):
    pct = units.fraction_to_percent(F.col("tcc"))
    return raw(spark, sf_dir).select(
        "event_id", pct.alias("cloud_cover_pct"), units.percent_to_fraction(pct).alias("cloud_cover_fraction")
    )


_CONVERTED = f"""converted AS (
  SELECT CAST(round(latitude * 4) AS BIGINT) * 10000 + CAST(round(longitude * 4) AS BIGINT) AS location_id,
         valid_time + INTERVAL 330 MINUTE AS valid_time,
         {_T} AS temperature, {S.bround('sp / 100', 2)} AS surface_pressure,
         tcc AS total_cloud_cover, lcc AS low_cloud_cover, mcc AS medium_cloud_cover, hcc AS high_cloud_cover,
         CASE WHEN hcc = 1 THEN NULL WHEN {S.bround('tp * 1000', 4)} < 0 THEN 0.0::DOUBLE
              ELSE {S.bround('tp * 1000', 4)} END AS precipitation,
         {S.bround(f"CASE WHEN ({_RH}) < 0 THEN 0.0 WHEN ({_RH}) > 100 THEN 100.0 ELSE ({_RH}) END", 2)} AS humidity,
         {S.bround('sqrt(u10 * u10 + v10 * v10)', 4)} AS wind_speed
  FROM raw)"""


@query(
    "prj_clean_raw",
    S.with_(S.RAW, _CONVERTED, S.interp(S.OBS_MEASURES, "converted", "interp"))
    + "SELECT location_id, valid_time, "
    + ", ".join(f"{S.hround(S.clip_expr(c), 6)} AS {c}" for c in S.OBS_MEASURES)
    + " FROM interp",
)
def q_prj_clean_raw(spark, sf_dir):
    """Raw reanalysis rows without an id, with upper-case padded headers and gaps, to the clean series."""
    r = raw(spark, sf_dir).drop("event_id").withColumn("tp", F.when(F.col("hcc") != 1, F.col("tp")))
    out = clean_raw(r.toDF(*[f" {c.upper()} " for c in r.columns]))
    return out.select(KEY, TIME, *[r6(F.col(c)).alias(c) for c in S.OBS_MEASURES])


@query(
    "prj_final_columns",
    CLEAN
    + """SELECT location_id, valid_time, temperature, surface_pressure, total_cloud_cover, low_cloud_cover,
       medium_cloud_cover, high_cloud_cover, precipitation, humidity, wind_speed FROM clean""",
)
def q_prj_final(spark, sf_dir):
    return clean_series(obs(spark, sf_dir))


@query(
    "flt_grid_point",
    RAW + "SELECT event_id, valid_time, t2m FROM raw WHERE latitude = 26.0 AND longitude = 83.0",
)
def q_flt_grid(spark, sf_dir):
    return quality.grid_point(raw(spark, sf_dir), 26.0, 83.0).select("event_id", "valid_time", "t2m")


@query(
    "flt_drop_null",
    FEAT
    + "SELECT location_id, valid_time, temperature FROM feat WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in FEATURE_NOT_NULL),
)
def q_flt_drop_null(spark, sf_dir):
    f = build_features(obs(spark, sf_dir), threshold=STANDIN_RAIN_THRESHOLD)
    return quality.drop_null_rows(f, FEATURE_NOT_NULL).select(KEY, TIME, "temperature")


_RANGE_COLS = S.OBS_MEASURES


@query(
    "qc_range_counts",
    OBS
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} < {S.BOUNDS[c][0]} OR {c} > {S.BOUNDS[c][1]}) AS violations FROM obs\n"
        for c in _RANGE_COLS
    ),
)
def q_qc_range_counts(spark, sf_dir):
    return quality.range_violations(obs(spark, sf_dir))


@query(
    "qc_range_clip",
    OBS + "SELECT location_id, valid_time, " + ", ".join(f"{S.clip_expr(c)} AS {c}" for c in _RANGE_COLS) + " FROM obs",
)
def q_qc_range_clip(spark, sf_dir):
    return quality.range_clip(obs(spark, sf_dir)).select(KEY, TIME, *_RANGE_COLS)


@query(
    "qc_validate_features",
    S.with_(S.OBS, S.CLEAN, S.feat(STANDIN_RAIN_THRESHOLD, source="clean"))
    + """, kept AS (SELECT * FROM feat WHERE temp_lag_1 IS NOT NULL AND temp_lag_24 IS NOT NULL
                   AND temp_rolling_6 IS NOT NULL),
chk AS (SELECT *, lag(temperature) OVER (PARTITION BY location_id ORDER BY valid_time) AS _expected FROM kept)
SELECT location_id, round(max(abs(_expected - temp_lag_1)), 6) AS lag1_max_diff,
       count(*) FILTER (WHERE rain_tomorrow NOT IN (0, 1)) AS non_binary_labels,
       CAST(0 AS BIGINT) AS null_cells,
       coalesce(max(abs(_expected - temp_lag_1)), 0) <= 0.01 AND count(*) FILTER (WHERE rain_tomorrow NOT IN (0, 1)) = 0 AS passed
FROM chk GROUP BY location_id""",
)
def q_qc_validate(spark, sf_dir):
    f = build_features(clean_table(spark, sf_dir, keep_index=True), threshold=STANDIN_RAIN_THRESHOLD)
    kept = quality.drop_null_rows(f, FEATURE_NOT_NULL)
    v = quality.validate_features(kept)
    return v.select(KEY, r6(F.col("lag1_max_diff")).alias("lag1_max_diff"), "non_binary_labels", "null_cells", "passed")


@query(
    "qc_time_gaps",
    OBS
    + """, d AS (SELECT location_id,
       date_diff('second', lag(valid_time) OVER (PARTITION BY location_id ORDER BY valid_time), valid_time) / 3600.0::DOUBLE AS gap_hours
  FROM obs),
c AS (SELECT location_id, gap_hours, count(*) AS n_gaps FROM d
      WHERE gap_hours IS NOT NULL AND gap_hours <> 1.0 GROUP BY 1, 2)
SELECT location_id, gap_hours, n_gaps, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY n_gaps DESC, gap_hours) AS rank FROM c)
WHERE rank <= 5""",
)
def q_qc_time_gaps(spark, sf_dir):
    return quality.time_gaps(obs(spark, sf_dir))


@query(
    "prj_model_inputs",
    S.with_(S.OBS, S.CLEAN, S.feat(STANDIN_RAIN_THRESHOLD, source="clean"))
    + "SELECT location_id, valid_time, "
    + ", ".join(RAIN_FEATURES)
    + ", hour_sin, hour_cos, month_sin, month_cos FROM feat",
)
def q_prj_model_inputs(spark, sf_dir):
    f = build_features(clean_table(spark, sf_dir, keep_index=True), threshold=STANDIN_RAIN_THRESHOLD)
    return quality.require_columns(f, RAIN_FEATURES).select(KEY, TIME, *RAIN_FEATURES, "hour_sin", "hour_cos", "month_sin", "month_cos")
