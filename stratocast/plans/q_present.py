"""Queries: presentation scalars and the prediction record (SC-3..11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import presentation as P
from ..functions.timeparts import day_label, hour_label
from ..operators import joins
from ..schema import KEY, TIME
from ..sources.tables import clean_table, daily_weather, load, scored_labels
from . import sqlparts as S
from .catalog import query, r6

SCORED = S.with_(S.SCORED)
CLEAN = S.with_(S.OBS, S.CLEAN)


def scored(spark, sf_dir):
    return scored_labels(load(spark, sf_dir, "labels"))


def clean(spark, sf_dir):
    return clean_table(spark, sf_dir)


@query(
    "sc_confidence",
    SCORED
    + """SELECT doc_id, CASE WHEN y_prob > 0.75 THEN 'high (rain likely)' WHEN y_prob > 0.55 THEN 'medium'
       WHEN y_prob < 0.25 THEN 'high (no rain likely)' ELSE 'low (uncertain)' END AS confidence FROM scored""",
)
def q_sc_confidence(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", P.confidence(F.col("y_prob")).alias("confidence"))


@query(
    "sc_decision",
    SCORED
    + f"""SELECT doc_id, y_prob >= 0.5 AS rain_tomorrow, {S.bround('y_prob', 4)} AS probability,
       CASE WHEN y_prob > 0.75 THEN 'high (rain likely)' WHEN y_prob > 0.55 THEN 'medium'
       WHEN y_prob < 0.25 THEN 'high (no rain likely)' ELSE 'low (uncertain)' END AS confidence,
       0.5::DOUBLE AS threshold_used FROM scored""",
)
def q_sc_decision(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", P.rain_record(F.col("y_prob")).alias("r")).select("doc_id", "r.*")


@query(
    "sc_icon",
    CLEAN
    + """SELECT location_id, valid_time, CASE WHEN coalesce(precipitation, 0) > 2 THEN '⛈️'
       WHEN coalesce(precipitation, 0) > 0.5 THEN '🌧️' WHEN coalesce(total_cloud_cover, 0) * 100 > 85 THEN '☁️'
       WHEN coalesce(total_cloud_cover, 0) * 100 > 40 THEN '⛅' ELSE '☀️' END AS icon FROM clean""",
)
def q_sc_icon(spark, sf_dir):
    c = clean(spark, sf_dir)
    return c.select(KEY, TIME, P.weather_icon(F.col("precipitation"), F.col("total_cloud_cover")).alias("icon"))


@query(
    "sc_description",
    CLEAN
    + """SELECT location_id, valid_time, CASE WHEN coalesce(precipitation, 0) > 2 THEN 'thunderstorm'
       WHEN coalesce(precipitation, 0) > 0.5 THEN 'rain' WHEN coalesce(total_cloud_cover, 0) * 100 > 85 THEN 'overcast'
       WHEN coalesce(total_cloud_cover, 0) * 100 > 60 THEN 'mostly cloudy'
       WHEN coalesce(total_cloud_cover, 0) * 100 > 30 THEN 'partly cloudy' ELSE 'clear sky' END AS description
FROM clean""",
)
def q_sc_description(spark, sf_dir):
    c = clean(spark, sf_dir)
    return c.select(
        KEY, TIME, P.weather_text(F.col("precipitation"), F.col("total_cloud_cover")).alias("description")
    )


@query(
    "sc_day_label",
    S.with_(S.DAILY)
    + f"""SELECT location_id, CAST(day AS TIMESTAMP) AS day, strftime(day, '%a, %b %d') AS date,
       CAST({S.bround('temperature_2m_min', 0)} AS INTEGER) AS temp_min,
       CAST({S.bround('temperature_2m_max', 0)} AS INTEGER) AS temp_max,
       CAST({S.bround('windspeed_10m_max', 0)} AS INTEGER) AS wind_speed FROM daily""",
)
def q_sc_day_label(spark, sf_dir):
    d = daily_weather(load(spark, sf_dir, "events"))
    return d.select(
        KEY,
        F.col("day").cast("timestamp_ntz").alias("day"),
        day_label(F.col("day")).alias("date"),
        P.half_even_int(F.col("temperature_2m_min")).alias("temp_min"),
        P.half_even_int(F.col("temperature_2m_max")).alias("temp_max"),
        P.half_even_int(F.col("windspeed_10m_max")).alias("wind_speed"),
    )


@query(
    "sc_hour_label",
    CLEAN
    + f"""SELECT location_id, valid_time, CAST(s.step AS INTEGER) AS step,
       strftime(valid_time + to_hours(s.step), '%H') || ':00' AS label,
       CAST({S.bround('temperature', 0)} AS INTEGER) AS temp
FROM clean JOIN range(1, 6) AS s(step) ON true""",
)
def q_sc_hour_label(spark, sf_dir):
    c = clean(spark, sf_dir)
    steps = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step")
    return c.select(KEY, TIME, "temperature", steps).select(
        KEY, TIME, "step", hour_label(F.col(TIME), F.col("step")).alias("label"),
        P.half_even_int(F.col("temperature")).alias("temp"),
    )


@query(
    "sc_range_pct",
    S.with_(S.OBS, S.CLEAN, S.DAILY)
    + """SELECT c.location_id, c.valid_time,
       round(CASE WHEN d.temperature_2m_max > d.temperature_2m_min
            THEN (c.temperature - d.temperature_2m_min) / (d.temperature_2m_max - d.temperature_2m_min) * 100
            ELSE 50.0 END, 6) AS range_pct
FROM clean c JOIN daily d ON d.location_id = c.location_id AND d.day = CAST(c.valid_time AS DATE)""",
)
def q_sc_range_pct(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    c = clean_table(spark, sf_dir)
    d = daily_weather(ev)
    j = c.join(d, (c[KEY] == d[KEY]) & (F.to_date(c[TIME]) == d["day"]))
    pct = P.range_position_pct(c["temperature"], d["temperature_2m_min"], d["temperature_2m_max"])
    return j.select(c[KEY], c[TIME], r6(pct).alias("range_pct"))


@query(
    "sc_hydro_bars",
    CLEAN
    + f"""SELECT location_id, valid_time,
       {S.hround('coalesce(CASE WHEN humidity > 100 THEN 100 WHEN humidity > 0 THEN humidity END, 0)::DOUBLE', 6)} AS humidity_bar,
       {S.hround('coalesce(CASE WHEN precipitation * 10 > 100 THEN 100 WHEN precipitation > 0 THEN precipitation * 10 END, 0)::DOUBLE', 6)} AS precip_bar,
       {S.hround('coalesce(CASE WHEN surface_pressure > 1040 THEN 100 WHEN surface_pressure > 980 THEN (surface_pressure - 980) / 60 * 100 END, 0)::DOUBLE', 6)} AS pressure_bar
FROM clean""",
)
def q_sc_hydro_bars(spark, sf_dir):
    c = clean(spark, sf_dir)
    bars = P.hydro_bars(F.col("humidity"), F.col("precipitation"), F.col("surface_pressure"))
    return c.select(KEY, TIME, *bars).select(KEY, TIME, *[r6(F.col(b)).alias(b) for b in ("humidity_bar", "precip_bar", "pressure_bar")])


@query(
    "sc_rain_tier",
    SCORED
    + """SELECT doc_id, CASE WHEN y_prob >= 0.5 THEN '🌧️' WHEN y_prob > 0.35 THEN '🌤️' ELSE '☀️' END AS rain_icon,
       CASE WHEN y_prob >= 0.5 THEN 'Rain expected tomorrow' ELSE 'No rain tomorrow' END AS rain_title,
       CAST(floor(y_prob * 100 + 0.5) AS INTEGER) AS prob_pct FROM scored""",
)
def q_sc_rain_tier(spark, sf_dir):
    s = scored(spark, sf_dir)
    p = F.col("y_prob")
    return s.select("doc_id", *P.rain_banner(p, p >= F.lit(0.5)))


@query(
    "prj_current_conditions",
    S.with_(S.OBS, S.CLEAN, S.DAILY)
    + f""", r AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY valid_time DESC) AS rk,
            count(*) OVER (PARTITION BY location_id) AS nr FROM clean),
h AS (SELECT location_id, max(nr) AS nr, max(CASE WHEN rk = 1 THEN temperature END) AS v0,
             max(CASE WHEN rk = 2 THEN temperature END) AS v1, max(CASE WHEN rk = 25 THEN temperature END) AS v24,
             avg(CASE WHEN rk BETWEEN 2 AND 7 THEN temperature END) AS m6,
             avg(CASE WHEN rk >= 2 THEN temperature END) AS mall FROM r GROUP BY 1),
t AS (SELECT r.*, CASE WHEN h.nr >= 2 THEN v1 ELSE v0 END AS l1, CASE WHEN h.nr >= 25 THEN v24 ELSE v0 END AS l24,
             CASE WHEN h.nr >= 7 THEN {S.bround('m6', 4)} WHEN h.nr > 1 THEN {S.bround('mall', 4)} ELSE v0 END AS r6
      FROM r JOIN h ON h.location_id = r.location_id WHERE rk = 1)
SELECT t.location_id, t.valid_time, {S.bround('t.temperature', 2)} AS temperature,
       {S.bround('t.temperature - t.wind_speed / 10', 2)} AS feels_like,
       {S.bround('d.temperature_2m_min', 2)} AS temp_min, {S.bround('d.temperature_2m_max', 2)} AS temp_max,
       {S.bround('l1', 2)} AS temp_lag_1, {S.bround('l24', 2)} AS temp_lag_24, {S.bround('r6', 4)} AS temp_rolling_6,
       {S.bround('t.humidity', 2)} AS humidity, {S.bround('t.surface_pressure', 2)} AS surface_pressure,
       {S.bround('t.total_cloud_cover', 4)} AS total_cloud_cover, {S.bround('t.wind_speed', 4)} AS wind_speed,
       {S.bround('t.low_cloud_cover', 4)} AS low_cloud_cover, {S.bround('t.medium_cloud_cover', 4)} AS medium_cloud_cover,
       {S.bround('t.high_cloud_cover', 4)} AS high_cloud_cover, {S.bround('t.precipitation', 4)} AS precipitation
FROM t LEFT JOIN daily d ON d.location_id = t.location_id AND d.day = CAST(t.valid_time AS DATE)""",
)
def q_prj_current(spark, sf_dir):
    # the stand-in has no apparent temperature: temperature less a tenth of the wind
    c = clean_table(spark, sf_dir).withColumn("apparent", F.col("temperature") - F.col("wind_speed") / 10)
    return joins.current_conditions(c, daily_weather(load(spark, sf_dir, "events")), "apparent")
