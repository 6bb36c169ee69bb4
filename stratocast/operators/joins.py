"""Join operators: variable merge, code lookup, place-name resolution, dashboard record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import presentation as P
from ..functions.timeparts import cyclic_features, day_label
from ..schema import FORECAST_FEATURES, KEY, RAIN_FEATURES, TIME, UNKNOWN_CODE, WEATHER_CODES
from . import windows
from .series import join_null_safe


def merge_variables(instant: DataFrame, accumulated: DataFrame, on=(TIME, "latitude", "longitude"), repeated: str = "error") -> DataFrame:
    """Attach accumulated variables to instantaneous rows by key (not by position): one row per
    instantaneous row that has a partner.

    An accumulated key that stands more than once would multiply rows.  ``repeated='error'``
    fails the job at the first such key, ``'first'`` takes its first row in input order and
    ``'all'`` joins each.  Either way a key's rows are combined map-side before the join."""
    if repeated == "all":
        return instant.join(accumulated, list(on), "inner")
    if repeated == "first":
        return instant.join(windows.dedup_first(accumulated, list(on), []), list(on), "inner")
    if repeated != "error":
        raise ValueError("repeated must be 'error', 'first' or 'all'")
    rest = [c for c in accumulated.columns if c not in on]
    one = accumulated.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*rest)).alias("_v"))
    key = F.concat_ws(", ", *[F.col(c).cast("string") for c in on])
    told = F.when(F.col("_n") == 1, F.col("_v")).otherwise(F.raise_error(F.concat(F.lit("accumulated key stands more than once: "), key)))
    return instant.join(one.withColumn("_v", told).select(*on, *[F.col("_v")[c].alias(c) for c in rest]), list(on), "inner")


def weather_codes(spark: SparkSession) -> DataFrame:
    """The fixed 17-row code table."""
    from ..sources.literals import literal_table

    return literal_table(spark, WEATHER_CODES, [("code", "int"), ("description", "string"), ("icon", "string")])


def lookup_codes(df: DataFrame, code_col: str = "weathercode") -> DataFrame:
    """Description and icon per code; unknown codes get the default pair.

    The code table has a fixed size of 17 rows, so it is always broadcast.
    """
    codes = F.broadcast(weather_codes(df.sparkSession))
    j = df.join(codes, df[code_col] == codes["code"], "left").drop("code")
    return j.withColumns(
        {
            "description": F.coalesce(F.col("description"), F.lit(UNKNOWN_CODE[0])),
            "icon": F.coalesce(F.col("icon"), F.lit(UNKNOWN_CODE[1])),
        }
    )


def normalise_place(c):
    return F.lower(F.trim(c))


def resolve_places(queries: DataFrame, gazetteer: DataFrame, query_col: str = "query") -> DataFrame:
    """Resolve free-text place names against a gazetteer.

    ``gazetteer`` has name, admin1, country, latitude, longitude (+ optional
    ``rank``, lower is better).  Names are trimmed and case-folded; an empty
    query is rejected, the best match wins, misses are flagged, and the display
    name joins the non-empty parts with ", ".
    """
    rank = F.col("rank") if "rank" in gazetteer.columns else F.lit(0)
    g = gazetteer.withColumn("_key", normalise_place(F.col("name"))).withColumn("_rank", rank)
    # best match per name as an aggregate (min of a struct led by the rank):
    # combined map-side, so a very common name never lands whole in one task
    packed = F.struct("_rank", "name", "latitude", "longitude", "admin1", "country")
    top = g.groupBy("_key").agg(F.min(packed).alias("_b")).select(
        "_key",
        F.col("_b.name").alias("place_name"),
        F.col("_b.admin1").alias("admin1"),
        F.col("_b.country").alias("country"),
        F.col("_b.latitude").alias("latitude"),
        F.col("_b.longitude").alias("longitude"),
    )
    q = queries.withColumn("_key", normalise_place(F.col(query_col)))
    # AQE broadcasts the gazetteer from its measured size, or splits a hot name
    j = q.join(top, "_key", "left")
    display = F.concat_ws(
        ", ",
        F.col("place_name"),
        F.when(F.col("admin1") != "", F.col("admin1")),
        F.when(F.col("country") != "", F.col("country")),
    )
    status = (
        F.when(F.col("_key") == "", F.lit("empty"))
        .when(F.col("place_name").isNull(), F.lit("not_found"))
        .otherwise(F.lit("ok"))
    )
    ok = status == "ok"
    return j.select(
        *queries.columns,
        status.alias("status"),
        F.when(ok, display).alias("display_name"),
        F.when(ok, F.col("latitude")).alias("latitude"),
        F.when(ok, F.col("longitude")).alias("longitude"),
    )


def current_conditions(series: DataFrame, daily: DataFrame, feels_like: str | None = None) -> DataFrame:
    """The newest row of each location as a display record, rounded field by field.

    ``daily`` gives the extremes of the row's day; ``feels_like`` names the column of
    the apparent temperature (null where the source has none).  The record holds the
    values the models take as well: lags and rolling mean of the rows before."""
    latest = windows.latest_features(series).select(KEY, "temp_lag_1", "temp_lag_24", "temp_rolling_6")
    newest = series.groupBy(KEY).agg(F.max(TIME).alias("_t"))
    row = join_null_safe(series, newest, [KEY]).filter(F.col(TIME) == F.col("_t")).drop("_t")
    day = daily.select(KEY, "day", "temperature_2m_min", "temperature_2m_max")
    j = join_null_safe(row.withColumn("day", F.to_date(TIME)), day, [KEY, "day"], "left")
    j = join_null_safe(j, latest, [KEY])
    b = F.bround
    apparent = F.col(feels_like) if feels_like else F.lit(None).cast("double")
    return j.select(
        KEY,
        TIME,
        b("temperature", 2).alias("temperature"),
        b(apparent, 2).alias("feels_like"),
        b("temperature_2m_min", 2).alias("temp_min"),
        b("temperature_2m_max", 2).alias("temp_max"),
        b("temp_lag_1", 2).alias("temp_lag_1"),
        b("temp_lag_24", 2).alias("temp_lag_24"),
        b("temp_rolling_6", 4).alias("temp_rolling_6"),
        b("humidity", 2).alias("humidity"),
        b("surface_pressure", 2).alias("surface_pressure"),
        b("total_cloud_cover", 4).alias("total_cloud_cover"),
        b("wind_speed", 4).alias("wind_speed"),
        *[b(c, 4).alias(c) for c in ("low_cloud_cover", "medium_cloud_cover", "high_cloud_cover", "precipitation")],
    )


def model_records(current: DataFrame) -> DataFrame:
    """The two ordered feature records of the live models from a display record."""
    hour, month = F.hour(TIME), F.month(TIME)
    full = current.select("*", month.alias("month"), *cyclic_features(hour, month))
    return full.select(
        KEY,
        TIME,
        F.struct(*[F.col(c) for c in FORECAST_FEATURES]).alias("forecast_features"),
        F.struct(*[F.col(c) for c in RAIN_FEATURES]).alias("rain_features"),
    )


def dashboard(
    current: DataFrame,
    hourly: DataFrame,
    daily: DataFrame,
    rain: DataFrame | None = None,
    forecast: DataFrame | None = None,
    places: DataFrame | None = None,
    hours: int = 24,
    days: int | None = None,
) -> DataFrame:
    """One record per location: current conditions, hourly strip, daily list, and
    where given the rain prediction (columns of its record) and the place name.

    With ``forecast`` (an array ``pred`` per location) the strip shows the hours it
    predicts, else the newest ``hours`` hours of each location; the daily list
    every day that ``daily`` holds for it (the days of a payload), or the newest
    ``days``.  Both come from per-location maxima and filters, without a window
    over a whole location.
    """
    newest = hourly.groupBy(KEY).agg(F.max(TIME).alias("_tmax"))
    strip = (
        hourly.join(newest, KEY)
        .filter(F.col(TIME) > F.col("_tmax") - F.make_dt_interval(F.lit(0), F.lit(hours)))
        .groupBy(KEY)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.col(TIME).alias("time"),
                        F.concat(F.date_format(TIME, "HH"), F.lit(":00")).alias("label"),
                        P.half_even_int(F.col("temperature")).alias("temp"),
                    )
                )
            ).alias("hourly")
        )
    )
    if forecast is not None:
        # the hours to come: one entry per forecast step after the newest row
        steps = forecast.join(newest, KEY).select(
            KEY,
            F.posexplode("pred").alias("_i", "_temp"),
            "_tmax",
        )
        at = F.col("_tmax") + F.make_dt_interval(F.lit(0), F.col("_i") + 1)
        strip = steps.groupBy(KEY).agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        at.alias("time"),
                        F.concat(F.date_format(at, "HH"), F.lit(":00")).alias("label"),
                        P.half_even_int(F.col("_temp")).alias("temp"),
                    )
                )
            ).alias("hourly")
        )
    last_day = daily.groupBy(KEY).agg(F.max("day").alias("_dmax"))
    dl = (
        lookup_codes(daily)
        .join(last_day, KEY)
        .filter(F.lit(True) if days is None else F.col("day") > F.date_sub(F.col("_dmax"), days))
        .groupBy(KEY)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.col("day"),
                        day_label(F.col("day")).alias("date"),
                        P.half_even_int(F.col("temperature_2m_min")).alias("temp_min"),
                        P.half_even_int(F.col("temperature_2m_max")).alias("temp_max"),
                        F.col("description"),
                        F.col("icon"),
                        P.half_even_int(F.col("windspeed_10m_max")).alias("wind_speed"),
                    )
                )
            ).alias("forecast")
        )
    )
    out = current.join(strip, KEY, "left").join(dl, KEY, "left")
    if rain is not None:
        out = out.join(rain, KEY, "left")
    if places is not None:
        out = out.join(places.select(KEY, F.col("display_name").alias("city")), KEY, "left")
    return out
