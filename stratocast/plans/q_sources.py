"""Queries: sources and sinks (SRC-1..5, SNK-1).

Each writes data Spark derives from the driver tables to a fresh folder under
the shared checkpoint directory, then reads it back through the source under
test.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as K
from ..schema import KEY, TIME
from ..session import shared_path
from ..sources import files, payloads
from ..sources.tables import daily_weather, load, obs_hourly, raw_grid
from . import sqlparts as S
from .catalog import query

RAW_TYPES = {"event_id": T.LongType(), "valid_time": T.TimestampNTZType()} | {
    c: T.DoubleType()
    for c in ["latitude", "longitude", "t2m", "d2m", "sp", "tp", "u10", "v10", "tcc", "lcc", "mcc", "hcc"]
}

OBS_SCHEMA = T.StructType(
    [T.StructField(KEY, T.LongType()), T.StructField(TIME, T.TimestampNTZType())]
    + [
        T.StructField(c, T.DoubleType())
        for c in ["temperature", "precipitation", "humidity", "surface_pressure", "wind_speed", "total_cloud_cover",
                  "low_cloud_cover", "medium_cloud_cover", "high_cloud_cover"]
    ]
    + [T.StructField("n", T.LongType())]
)

RAW_COLS = "event_id, valid_time, latitude, longitude, t2m, d2m, sp, tp, u10, v10, tcc, lcc, mcc, hcc"
OBS_COLS = "location_id, valid_time, temperature, precipitation, humidity, surface_pressure, wind_speed, total_cloud_cover, low_cloud_cover, medium_cloud_cover, high_cloud_cover, n"


@query("src_csv_normalised", S.with_(S.RAW) + f"SELECT {RAW_COLS} FROM raw")
def q_src_csv_normalised(spark, sf_dir):
    r = raw_grid(load(spark, sf_dir, "events"))
    messy = r.toDF(*[(f"  {c.upper()} " if i % 2 else f"{c.title()}  ") for i, c in enumerate(r.columns)])
    path = shared_path(spark, "raw_csv")
    files.write_csv(messy, path)
    return files.read_csv_normalised(spark, path, RAW_TYPES)


@query("src_typed_series", S.with_(S.OBS) + f"SELECT {OBS_COLS} FROM obs")
def q_src_typed_series(spark, sf_dir):
    o = obs_hourly(load(spark, sf_dir, "events"))
    path = shared_path(spark, "obs_csv")
    files.write_csv(o, path)
    return files.read_csv_typed(spark, path, OBS_SCHEMA)


@query(
    "src_partitioned_union",
    S.with_(S.RAW)
    + """SELECT event_id, valid_time, latitude, longitude, t2m, sp, u10, v10, CAST(NULL AS DOUBLE) AS tp,
       CAST(year(valid_time) AS INTEGER) AS year, CAST(month(valid_time) AS INTEGER) AS month, 'instant' AS var_set
FROM raw
UNION ALL
SELECT event_id, valid_time, latitude, longitude, NULL, NULL, NULL, NULL, tp,
       CAST(year(valid_time) AS INTEGER), CAST(month(valid_time) AS INTEGER), 'accum'
FROM raw""",
)
def q_src_partitioned_union(spark, sf_dir):
    r = files.with_year_month(raw_grid(load(spark, sf_dir, "events")))
    instant_path = shared_path(spark, "grid_instant")
    accum_path = shared_path(spark, "grid_accum")
    files.write_partitioned(
        r.select("event_id", TIME, "latitude", "longitude", "t2m", "sp", "u10", "v10", "year", "month"),
        instant_path,
        ["year", "month"],
    )
    files.write_partitioned(
        r.select("event_id", TIME, "latitude", "longitude", "tp", "year", "month"), accum_path, ["year", "month"]
    )
    inst = files.read_partitioned(spark, instant_path).withColumn("var_set", F.lit("instant"))
    acc = files.read_partitioned(spark, accum_path).withColumn("var_set", F.lit("accum"))
    return inst.unionByName(acc, allowMissingColumns=True).select(
        "event_id", TIME, "latitude", "longitude", "t2m", "sp", "u10", "v10", "tp", "year", "month", "var_set"
    )


@query(
    "src_hourly_payload",
    S.with_(S.OBS)
    + """SELECT location_id, valid_time, temperature, humidity / 10 AS dewpoint FROM obs
WHERE temperature IS NOT NULL AND humidity IS NOT NULL""",
)
def q_src_hourly_payload(spark, sf_dir):
    o = obs_hourly(load(spark, sf_dir, "events")).withColumn("dewpoint", F.col("humidity") / 10)
    return payloads.parse_hourly_payloads(payloads.build_hourly_payloads(o))


@query(
    "src_daily_payload",
    S.with_(S.DAILY)
    + """SELECT location_id, CAST(day AS TIMESTAMP) AS day, temperature_2m_min, temperature_2m_max,
       weathercode, windspeed_10m_max FROM daily""",
)
def q_src_daily_payload(spark, sf_dir):
    d = daily_weather(load(spark, sf_dir, "events"))
    out = payloads.parse_daily_payloads(payloads.build_daily_payloads(d))
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


def _live_sql():
    clouds = ", ".join(f"{S.bround(f'{c} * 100 / 100', 4)} AS {c}" for c in payloads.CLOUDS.values())
    dew = "(humidity / 10)"
    rh = f"100.0::DOUBLE * exp({K.MAGNUS_A}::DOUBLE * {dew} / ({K.MAGNUS_B}::DOUBLE + {dew})) / exp({K.MAGNUS_A}::DOUBLE * temperature / ({K.MAGNUS_B}::DOUBLE + temperature))"
    return S.with_(S.OBS) + f""", d AS (SELECT *, CAST(valid_time AS DATE) AS day FROM obs),
k AS (SELECT *, row_number() OVER (PARTITION BY location_id, day ORDER BY valid_time DESC) AS back,
             min(temperature) OVER w AS temp_min, max(temperature) OVER w AS temp_max,
             CAST(count(humidity) OVER w AS INTEGER) AS hours FROM d WINDOW w AS (PARTITION BY location_id, day))
SELECT location_id, valid_time, temperature, surface_pressure, CASE WHEN precipitation > 0 THEN precipitation ELSE 0 END AS precipitation,
       wind_speed, {clouds}, {S.bround(rh, 2)} AS humidity, temp_min, temp_max, hours FROM k WHERE back = 1"""


@query("src_live_payload", _live_sql())
def q_src_live_payload(spark, sf_dir):
    """Current conditions from whole live payloads; a dry hour leaves precipitation out."""
    o = obs_hourly(load(spark, sf_dir, "events")).withColumn("dewpoint", F.col("humidity") / 10)
    o = o.withColumn("precipitation", F.when(F.col("precipitation") > 0, F.col("precipitation")))
    built = payloads.build_live_payloads(o)
    return payloads.current_conditions(payloads.parse_live_payloads(built)).drop("day", "corrupt")


@query("snk_roundtrip", S.with_(S.OBS) + f"SELECT {OBS_COLS} FROM obs")
def q_snk_roundtrip(spark, sf_dir):
    o = obs_hourly(load(spark, sf_dir, "events"))
    path = shared_path(spark, "obs_parquet")
    files.write_partitioned(o, path, [KEY])
    back = files.read_partitioned(spark, path)
    return back.select(*[F.col(c).cast(o.schema[c].dataType).alias(c) for c in o.columns])
