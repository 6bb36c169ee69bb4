"""Driver tables and the stand-in weather inputs derived from them.

No driver table holds weather, so the operators run on deterministic stand-ins
computed from ``events`` (see FIXTURES.md part B).  Each stand-in is a plain
aggregation or projection, so its work grows with the table it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeparts import trunc_hour
from ..session import table_path

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Users of one stand-in location: locations, and so series rows, grow with the table.
USERS_PER_LOCATION = 10
# Forward-24 label threshold used with the stand-in (1.0 marks nearly every hour).
STANDIN_RAIN_THRESHOLD = 48.0


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def location_of(user_id: Column) -> Column:
    return F.floor(user_id / F.lit(USERS_PER_LOCATION)).cast("long").alias("location_id")


def hourly_measures() -> list[Column]:
    """Aggregates of one stand-in hour, for the batch series and the stream alike."""
    v = F.col("value")
    et = F.col("event_type")
    errors = F.avg(F.when(et == "error", F.lit(1.0)).otherwise(F.lit(0.0)))
    return [
        (F.avg(v) / 5).alias("temperature"),
        (F.avg(F.when(et == "purchase", v).otherwise(F.lit(0.0))) / 5).alias("precipitation"),
        F.avg(F.when(et == "view", v)).alias("humidity"),
        (F.lit(1000.0) + F.avg(v) / 10).alias("surface_pressure"),
        (F.max(v) / 10).alias("wind_speed"),
        errors.alias("total_cloud_cover"),
        (F.avg(v) / 300).alias("low_cloud_cover"),
        (F.max(v) / 1000).alias("medium_cloud_cover"),
        (errors / 2).alias("high_cloud_cover"),
        F.count(F.lit(1)).alias("n"),
    ]


def obs_hourly(events: DataFrame) -> DataFrame:
    """Hourly observation series per location (FIXTURES.md B1).

    One partial+final hash aggregation keyed by (location, hour): a hot key is
    combined map-side before the shuffle, so no single task sees its raw rows.
    """
    return events.groupBy(
        location_of(F.col("user_id")), trunc_hour(F.col("ts")).alias("valid_time")
    ).agg(*hourly_measures())


def raw_grid(events: DataFrame) -> DataFrame:
    """Reanalysis-style raw rows (Kelvin, Pa, metres, wind components) per event.

    latitude/longitude place each user on a small grid; cloud fractions are
    chosen so that some rows fall outside the 0-1 validity range.
    """
    v = F.col("value")
    uid = F.col("user_id")
    return events.select(
        F.col("event_id"),
        F.col("ts").alias("valid_time"),
        (F.lit(26.0) + F.lit(0.25) * (uid % 4)).alias("latitude"),
        (F.lit(83.0) + F.lit(0.25) * (uid % 3)).alias("longitude"),
        (F.lit(273.15) + v / 10).alias("t2m"),
        (F.lit(273.15) + v / 20).alias("d2m"),
        (F.lit(100000.0) + v).alias("sp"),
        ((v - 10) / 1000).alias("tp"),
        (v / 50).alias("u10"),
        (uid / 10.0).alias("v10"),
        (v / 200).alias("tcc"),
        (v / 400).alias("lcc"),
        (v / 800).alias("mcc"),
        F.when(F.col("event_type") == "error", F.lit(1.0)).otherwise(F.lit(0.0)).alias("hcc"),
    )


def daily_weather(events: DataFrame) -> DataFrame:
    """Daily extremes per location with a weather code from ``props.$.k``."""
    v = F.col("value")
    code = F.get_json_object(F.col("props"), "$.k").cast("int")
    return events.groupBy(
        location_of(F.col("user_id")), F.to_date(F.col("ts")).alias("day")
    ).agg(
        (F.min(v) / 5).alias("temperature_2m_min"),
        (F.max(v) / 5).alias("temperature_2m_max"),
        F.max(code).alias("weathercode"),
        (F.max(v) / 10).alias("windspeed_10m_max"),
    )


def order_months(orders: DataFrame) -> DataFrame:
    """Orders with the month of their date: the only multi-month series."""
    return orders.select(
        F.month(F.col("o_orderdate")).alias("month"),
        F.col("o_totalprice"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )


def scored_labels(labels: DataFrame) -> DataFrame:
    """Truth and a deterministic score per document (FIXTURES.md B2)."""
    return labels.select(
        F.col("doc_id"),
        F.col("quality").alias("y_true"),
        F.col("toxic").alias("y_true_2"),
        (((F.col("doc_id") * 7919) % 1000) / 1000.0).alias("y_prob"),
    )


# --- derived tables written once per application ----------------------------

_DERIVED: dict[tuple[str, str, str], str] = {}


def forget_derived() -> None:
    """Build derived tables anew from here on."""
    _DERIVED.clear()


def derived_path(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """Folder in the shared checkpoint folder that ``write(path)`` fills once per
    (application, input folder, name)."""
    from ..session import shared_path

    key = (spark.sparkContext.applicationId, sf_dir, name)
    path = _DERIVED.get(key)
    if path is None:
        path = shared_path(spark, name)
        write(path)
        _DERIVED[key] = path
    return path


def derived(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Write ``build()`` once per (application, input folder, name) as Parquet in
    the shared checkpoint folder and read it back.

    Later stages branch (row-index counts, carry tables, joins); reading a
    written table keeps each branch from re-deriving it from the raw events, and
    the files survive executor loss.
    """
    return spark.read.parquet(derived_path(spark, sf_dir, name, lambda path: build().write.mode("overwrite").parquet(path)))


def obs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly stand-in series, built once from ``events``."""
    return derived(spark, sf_dir, "obs_hourly", lambda: obs_hourly(load(spark, sf_dir, "events")))


def clean_table(spark: SparkSession, sf_dir: str, keep_index: bool = False) -> DataFrame:
    """The cleaned hourly series (with its row index ``_rn``), built once."""
    from ..plans.clean import clean_series

    t = derived(spark, sf_dir, "clean_hourly", lambda: clean_series(obs_table(spark, sf_dir), keep_index=True))
    return t if keep_index else t.drop("_rn")
