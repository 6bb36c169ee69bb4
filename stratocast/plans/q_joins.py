"""Queries: joins (JN-1..4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import presentation
from ..operators import joins, windows
from ..schema import DEFAULT_THRESHOLD, KEY, TIME, WEATHER_CODES
from ..sources.tables import clean_table, daily_weather, load, raw_grid
from . import sqlparts as S
from .catalog import query


@query(
    "jn_variables",
    S.with_(S.RAW)
    + """SELECT a.event_id, a.valid_time, a.latitude, a.longitude, a.t2m, a.sp, b.tp
FROM raw a JOIN raw b ON a.valid_time = b.valid_time AND a.latitude = b.latitude AND a.longitude = b.longitude""",
)
def q_jn_variables(spark, sf_dir):
    r = raw_grid(load(spark, sf_dir, "events"))
    instant = r.select("event_id", TIME, "latitude", "longitude", "t2m", "sp")
    accumulated = r.select(TIME, "latitude", "longitude", "tp")
    # users of one grid cell share a key and an hour: every row of theirs
    return joins.merge_variables(instant, accumulated, repeated="all")


@query(
    "jn_variables_hourly",
    S.with_(S.RAW)
    + """SELECT a.event_id, a.valid_time, a.latitude, a.longitude, a.t2m, a.sp, b.tp
FROM raw a JOIN (SELECT valid_time, latitude, longitude, sum(tp) AS tp FROM raw GROUP BY 1, 2, 3) b
  ON a.valid_time = b.valid_time AND a.latitude = b.latitude AND a.longitude = b.longitude""",
)
def q_jn_variables_hourly(spark, sf_dir):
    """One accumulated row per key: each instantaneous row once, a repeated key fails the job."""
    r = raw_grid(load(spark, sf_dir, "events"))
    accumulated = r.groupBy(TIME, "latitude", "longitude").agg(F.sum("tp").alias("tp"))
    return joins.merge_variables(r.select("event_id", TIME, "latitude", "longitude", "t2m", "sp"), accumulated)


@query(
    "jn_code_lookup",
    """WITH codes(code, description, icon) AS (VALUES """
    + ", ".join(f"({c}, '{d}', '{i}')" for c, d, i in WEATHER_CODES)
    + """)
SELECT e.event_id, CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS weathercode,
       coalesce(c.description, 'Unknown') AS description, coalesce(c.icon, '01d') AS icon
FROM events e LEFT JOIN codes c ON c.code = CAST(json_extract_string(e.props, '$.k') AS INTEGER)""",
)
def q_jn_code_lookup(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("weathercode")
    )
    return joins.lookup_codes(ev)


def _gazetteer(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    r = load(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("name"),
        F.lit(None).cast("string").alias("admin1"),
        F.col("r_name").alias("country"),
        F.col("n_nationkey").cast("double").alias("latitude"),
        (F.col("n_regionkey") * 10).cast("double").alias("longitude"),
        F.col("n_nationkey").alias("rank"),
    )


def _place_queries(spark, sf_dir):
    """One lookup per customer: padded, lower-case, unknown or empty forms of its nation."""
    c = load(spark, sf_dir, "customer")
    n = load(spark, sf_dir, "nation")
    form = F.col("c_custkey") % 4
    q = (
        F.when(form == 0, F.concat(F.lit("  "), F.col("n_name"), F.lit("  ")))
        .when(form == 1, F.lower(F.col("n_name")))
        .when(form == 2, F.concat(F.col("n_name"), F.lit("ville")))
        .otherwise(F.lit("   "))
    )
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", q.alias("query"))


@query(
    "jn_gazetteer",
    """WITH g AS (SELECT n_name AS name, CAST(NULL AS VARCHAR) AS admin1, r_name AS country,
                  CAST(n_nationkey AS DOUBLE) AS latitude, CAST(n_regionkey * 10 AS DOUBLE) AS longitude
           FROM nation JOIN region ON n_regionkey = r_regionkey),
q AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '  ' || n_name || '  '
                                          WHEN 1 THEN lower(n_name)
                                          WHEN 2 THEN n_name || 'ville' ELSE '   ' END AS query
      FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT q.c_custkey, q.query,
       CASE WHEN lower(trim(q.query)) = '' THEN 'empty' WHEN g.name IS NULL THEN 'not_found' ELSE 'ok' END AS status,
       CASE WHEN lower(trim(q.query)) <> '' AND g.name IS NOT NULL
            THEN concat_ws(', ', g.name, nullif(g.admin1, ''), nullif(g.country, '')) END AS display_name,
       CASE WHEN lower(trim(q.query)) <> '' THEN g.latitude END AS latitude,
       CASE WHEN lower(trim(q.query)) <> '' THEN g.longitude END AS longitude
FROM q LEFT JOIN g ON lower(trim(g.name)) = lower(trim(q.query))""",
)
def q_jn_gazetteer(spark, sf_dir):
    return joins.resolve_places(_place_queries(spark, sf_dir), _gazetteer(spark, sf_dir))


_P = "((location_id * 37) % 100) / 100.0::DOUBLE"


@query(
    "jn_dashboard",
    S.with_(S.OBS, S.CLEAN, S.DAILY)
    + f""", newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY valid_time DESC) AS rk FROM clean) WHERE rk = 1),
strip AS (SELECT location_id, string_agg(strftime(valid_time + to_hours(CAST(i AS INTEGER)), '%H') || ':00=' ||
                 CAST(CAST({S.bround('temperature + i / 2.0::DOUBLE', 0)} AS INTEGER) AS VARCHAR), ',' ORDER BY i) AS hourly
          FROM newest, range(1, 6) AS s(i) GROUP BY 1),
days AS (SELECT location_id, count(*) AS n_days,
                string_agg(CAST(day AS VARCHAR) || '=' || CAST(CAST({S.bround('temperature_2m_min', 0)} AS INTEGER) AS VARCHAR) || '/' ||
                           CAST(CAST({S.bround('temperature_2m_max', 0)} AS INTEGER) AS VARCHAR), ',' ORDER BY day) AS forecast
         FROM daily GROUP BY 1)
SELECT n.location_id, n.valid_time, {S.bround('n.temperature', 2)} AS temperature, strip.hourly, days.n_days, days.forecast,
       {_P.replace('location_id', 'n.location_id')} >= 0.5 AS rain_tomorrow,
       round({_P.replace('location_id', 'n.location_id')}, 4) AS probability,
       nation.n_name || ', ' || region.r_name AS city
FROM newest n JOIN strip ON strip.location_id = n.location_id LEFT JOIN days ON days.location_id = n.location_id
LEFT JOIN nation ON n_nationkey = n.location_id % 25 LEFT JOIN region ON r_regionkey = n_regionkey""",
)
def q_jn_dashboard(spark, sf_dir):
    """The whole record per location; forecast and rain score are plain functions of the
    newest row and the location here, so that SQL can restate them."""
    clean = clean_table(spark, sf_dir)
    daily = daily_weather(load(spark, sf_dir, "events"))
    current = joins.current_conditions(clean, daily)
    steps = F.array(*[F.col("temperature") + F.lit(i / 2.0) for i in range(1, 6)])
    newest = windows.last_n_rows(clean, 1)
    forecast = newest.select(KEY, steps.alias("pred"))
    p = ((F.col(KEY) * 37) % 100) / F.lit(100.0)
    rain = newest.select(KEY, presentation.rain_record(p, DEFAULT_THRESHOLD).alias("rain_prediction"))
    places = joins.resolve_places(
        newest.join(_gazetteer(spark, sf_dir).select(F.col("rank").alias("_n"), "name"), F.col(KEY) % 25 == F.col("_n")).select(KEY, F.col("name").alias("query")),
        _gazetteer(spark, sf_dir),
    )
    d = joins.dashboard(current, clean, daily, rain, forecast, places)
    return d.select(
        KEY,
        TIME,
        "temperature",
        F.array_join(F.transform("hourly", lambda x: F.concat(x["label"], F.lit("="), x["temp"].cast("string"))), ",").alias("hourly"),
        F.size("forecast").cast("long").alias("n_days"),
        F.array_join(
            F.transform("forecast", lambda x: F.concat(x["day"].cast("string"), F.lit("="), x["temp_min"].cast("string"), F.lit("/"), x["temp_max"].cast("string"))), ","
        ).alias("forecast"),
        F.col("rain_prediction.rain_tomorrow").alias("rain_tomorrow"),
        F.col("rain_prediction.probability").alias("probability"),
        "city",
    )
