"""Nested JSON payloads (live hourly feed, daily forecast, model metadata).

Payloads are built and parsed with built-in JSON functions: ``to_json`` over a
bounded per-(location, day/week) group, ``from_json`` + ``arrays_zip`` +
``inline`` to turn parallel arrays back into rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as K
from ..functions import units
from ..schema import KEY, TIME

TIME_FMT = "yyyy-MM-dd'T'HH:mm"
DAY_FMT = "yyyy-MM-dd"

HOURLY_SCHEMA = T.StructType(
    [
        T.StructField(
            "hourly",
            T.StructType(
                [
                    T.StructField("time", T.ArrayType(T.StringType())),
                    T.StructField("temperature_2m", T.ArrayType(T.DoubleType())),
                    T.StructField("dewpoint_2m", T.ArrayType(T.DoubleType())),
                ]
            ),
        ),
    ]
)

DAILY_SCHEMA = T.StructType(
    [
        T.StructField(
            "daily",
            T.StructType(
                [
                    T.StructField("time", T.ArrayType(T.StringType())),
                    T.StructField("temperature_2m_min", T.ArrayType(T.DoubleType())),
                    T.StructField("temperature_2m_max", T.ArrayType(T.DoubleType())),
                    T.StructField("weathercode", T.ArrayType(T.IntegerType())),
                    T.StructField("windspeed_10m_max", T.ArrayType(T.DoubleType())),
                ]
            ),
        )
    ]
)


def build_hourly_payloads(series: DataFrame, dew_col: str = "dewpoint") -> DataFrame:
    """(location, day, payload JSON) with the day's hourly arrays (<= 24 entries)."""
    rows = F.array_sort(
        F.collect_list(
            F.struct(
                F.col(TIME).alias("t"),
                F.col("temperature").alias("temp"),
                F.col(dew_col).alias("dew"),
            )
        )
    )
    g = series.groupBy(KEY, F.to_date(F.col(TIME)).alias("day")).agg(rows.alias("r"))
    hourly = F.struct(
        F.transform("r", lambda x: F.date_format(x["t"], TIME_FMT)).alias("time"),
        F.transform("r", lambda x: x["temp"]).alias("temperature_2m"),
        F.transform("r", lambda x: x["dew"]).alias("dewpoint_2m"),
    )
    return g.select(KEY, "day", F.to_json(F.struct(hourly.alias("hourly"))).alias("payload"))


def parse_hourly_payloads(payloads: DataFrame) -> DataFrame:
    """Payload -> one row per hour: zip the parallel arrays, parse the time,
    drop incomplete entries."""
    p = payloads.select(KEY, F.from_json("payload", HOURLY_SCHEMA).alias("j"))
    z = p.select(
        KEY,
        F.inline(F.arrays_zip("j.hourly.time", "j.hourly.temperature_2m", "j.hourly.dewpoint_2m")),
    ).toDF(KEY, "time", "temperature", "dewpoint")
    out = z.select(KEY, F.to_timestamp_ntz(F.col("time"), F.lit(TIME_FMT)).alias(TIME), "temperature", "dewpoint")
    return out.na.drop(subset=[TIME, "temperature", "dewpoint"])


# --- the whole live payload: current conditions, hourly history, daily extremes -----

#: Percentages of the current section that become fractions.
CLOUDS = {"cloud_cover": "total_cloud_cover", "cloud_cover_low": "low_cloud_cover", "cloud_cover_mid": "medium_cloud_cover", "cloud_cover_high": "high_cloud_cover"}
LIVE_SCHEMA = """current struct<time: string, temperature_2m: double, apparent_temperature: double, surface_pressure: double, precipitation: double,
dewpoint_2m: double, wind_speed_10m: double, cloud_cover: double, cloud_cover_low: double, cloud_cover_mid: double, cloud_cover_high: double>,
hourly struct<time: array<string>, temperature_2m: array<double>, dewpoint_2m: array<double>>,
daily struct<time: array<string>, temperature_2m_min: array<double>, temperature_2m_max: array<double>>, _corrupt string"""


def build_live_payloads(series: DataFrame, dew_col: str = "dewpoint") -> DataFrame:
    """(location, day, payload JSON): the day's hours, its extremes, and its last hour as the current
    conditions (fields that are null are left out, as a service leaves them out)."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(TIME).alias("t"), F.col("temperature").alias("temp"), F.col(dew_col).alias("dew"))))
    values = ["temperature", "surface_pressure", "precipitation", dew_col, "wind_speed", *CLOUDS.values()]
    last = F.max_by(F.struct(*[F.col(c) for c in values]), F.col(TIME)).alias("last")
    g = series.groupBy(KEY, F.to_date(F.col(TIME)).alias("day")).agg(rows.alias("r"), last, F.min("temperature").alias("lo"), F.max("temperature").alias("hi"))
    now = F.struct(
        F.date_format(F.element_at("r", -1)["t"], TIME_FMT).alias("time"), F.col("last.temperature").alias("temperature_2m"), F.col("last.surface_pressure").alias("surface_pressure"),
        F.col("last.precipitation").alias("precipitation"), F.col("last")[dew_col].alias("dewpoint_2m"), F.col("last.wind_speed").alias("wind_speed_10m"),
        *[(F.col("last")[c] * 100).alias(name) for name, c in CLOUDS.items()],
    )
    hourly = F.struct(
        F.transform("r", lambda x: F.date_format(x["t"], TIME_FMT)).alias("time"), F.transform("r", lambda x: x["temp"]).alias("temperature_2m"), F.transform("r", lambda x: x["dew"]).alias("dewpoint_2m")
    )
    daily = F.struct(F.array(F.date_format("day", DAY_FMT)).alias("time"), F.array("lo").alias("temperature_2m_min"), F.array("hi").alias("temperature_2m_max"))
    return g.select(KEY, "day", F.to_json(F.struct(now.alias("current"), hourly.alias("hourly"), daily.alias("daily"))).alias("payload"))


def parse_live_payloads(payloads: DataFrame) -> DataFrame:
    """Payload -> its sections as one nested row; ``corrupt`` has the text of a payload that is no such document."""
    keep = [c for c in payloads.columns if c != "payload"]
    j = F.from_json("payload", LIVE_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"})
    return payloads.select(*keep, j.alias("j")).select(*keep, "j.current", "j.hourly", "j.daily", F.col("j._corrupt").alias("corrupt"))


def current_conditions(parsed: DataFrame) -> DataFrame:
    """One record per payload: the current section in the library's names and units, the day's extremes, and the
    hours of history it brings.  Precipitation that the service leaves out is 0, cloud cover comes as a fraction
    (4 dp), humidity from temperature and dew point; other missing fields are null, a corrupt payload gives a
    record of nulls with its text."""
    now, day = F.col("current"), F.col("daily")
    keep = [c for c in parsed.columns if c not in ("current", "hourly", "daily", "corrupt")]
    there = now.isNotNull()
    whole = F.arrays_zip(F.col("hourly.time"), F.col("hourly.temperature_2m"), F.col("hourly.dewpoint_2m"))
    full = F.filter(whole, lambda h: h["time"].isNotNull() & h["temperature_2m"].isNotNull() & h["dewpoint_2m"].isNotNull())
    return parsed.select(
        *keep,
        F.to_timestamp_ntz(now["time"], F.lit(TIME_FMT)).alias(TIME),
        now["temperature_2m"].alias("temperature"),
        now["surface_pressure"].alias("surface_pressure"),
        F.when(there, F.coalesce(now["precipitation"], F.lit(0.0))).alias("precipitation"),
        now["wind_speed_10m"].alias("wind_speed"),
        *[units.percent_to_fraction(now[c]).alias(name) for c, name in CLOUDS.items()],
        units.relative_humidity(now["temperature_2m"], now["dewpoint_2m"], clip=False).alias("humidity"),
        F.get(day["temperature_2m_min"], 0).alias("temp_min"),
        F.get(day["temperature_2m_max"], 0).alias("temp_max"),
        F.when(there, F.size(full)).alias("hours"),
        "corrupt",
    )


def build_daily_payloads(daily: DataFrame) -> DataFrame:
    """(location, week, payload JSON) with up to 7 days of parallel arrays."""
    week = F.floor(F.datediff(F.col("day"), F.lit("1970-01-05").cast("date")) / 7).alias("week")
    rows = F.array_sort(
        F.collect_list(
            F.struct("day", "temperature_2m_min", "temperature_2m_max", "weathercode", "windspeed_10m_max")
        )
    )
    g = daily.groupBy(KEY, week).agg(rows.alias("r"))
    d = F.struct(
        F.transform("r", lambda x: F.date_format(x["day"], DAY_FMT)).alias("time"),
        F.transform("r", lambda x: x["temperature_2m_min"]).alias("temperature_2m_min"),
        F.transform("r", lambda x: x["temperature_2m_max"]).alias("temperature_2m_max"),
        F.transform("r", lambda x: x["weathercode"]).alias("weathercode"),
        F.transform("r", lambda x: x["windspeed_10m_max"]).alias("windspeed_10m_max"),
    )
    return g.select(KEY, "week", F.to_json(F.struct(d.alias("daily"))).alias("payload"))


def parse_daily_payloads(payloads: DataFrame) -> DataFrame:
    """Payload -> one row per day; a payload without a daily section gives no rows."""
    p = payloads.select(KEY, F.from_json("payload", DAILY_SCHEMA).alias("j"))
    z = p.select(
        KEY,
        F.inline(
            F.arrays_zip(
                "j.daily.time",
                "j.daily.temperature_2m_min",
                "j.daily.temperature_2m_max",
                "j.daily.weathercode",
                "j.daily.windspeed_10m_max",
            )
        ),
    ).toDF(KEY, "time", "temperature_2m_min", "temperature_2m_max", "weathercode", "windspeed_10m_max")
    return z.select(
        KEY,
        F.to_date(F.col("time"), DAY_FMT).alias("day"),
        "temperature_2m_min",
        "temperature_2m_max",
        "weathercode",
        "windspeed_10m_max",
    )


# --- model metadata documents -----------------------------------------------------

#: Fields of the classifier's document, in order.
RAIN_META = """model string, features array<string>, target string, best_threshold double, best_iteration int, train_rows long, test_rows long,
hyperparameters map<string, double>, cv_results struct<mean_accuracy: double, std_accuracy: double, mean_f1: double, std_f1: double, mean_roc_auc: double, std_roc_auc: double>,
roc_auc double, avg_precision double, metrics_at_0_5 struct<accuracy: double, f1_score: double>,
metrics_at_best_threshold struct<threshold: double, accuracy: double, f1_score: double>, feature_importance_gain map<string, double>"""
#: Fields of the forecaster's document, in order; keys of ``per_step_metrics`` are the steps.
TEMP_META = """model string, target string, features array<string>, target_idx int, lookback int, forecast_n int, n_features int,
penalty array<double>, rounds int, train_samples long, val_samples long, test_samples long,
metrics struct<mae_celsius: double, rmse_celsius: double, r2_score: double>, per_step_metrics map<string, struct<mae: double, rmse: double, r2: double>>, scaler_path string"""


def _r4(x):
    return None if x is None else round(float(x), 4)


def rain_meta(spark: SparkSession, model, threshold: float, metrics: dict, cv: dict, gain: dict) -> DataFrame:
    """The classifier's document: ``metrics`` as its bundle holds them, ``cv`` metric -> (mean, std), ``gain`` per feature."""
    order = sorted(gain.items(), key=lambda x: -x[1])
    params = {
        "n_estimators": K.RAIN_TREES, "max_depth": K.RAIN_DEPTH, "learning_rate": K.RAIN_LEARNING_RATE, "subsample": K.RAIN_SUBSAMPLE,
        "colsample_bytree": K.RAIN_COLSAMPLE, "random_state": K.RAIN_SEED, "early_stopping_rounds": K.EARLY_STOP_ROUNDS,
    }
    row = (
        "gbt", model.features, "rain_tomorrow", threshold, model.best_iteration, metrics["train_rows"], metrics["test_rows"],
        {k: float(v) for k, v in params.items()}, tuple(_r4(v) for m in ("accuracy", "f1", "roc_auc") for v in cv[m]),
        _r4(metrics["roc_auc"]), _r4(metrics["avg_precision"]), tuple(map(_r4, metrics["at_0_5"])),
        (threshold, *map(_r4, metrics["at_best"])), {k: _r4(v) for k, v in order},
    )
    return spark.createDataFrame([row], RAIN_META)


def temp_meta(spark: SparkSession, model, metrics: dict, scaler_path: str) -> DataFrame:
    """The forecaster's document: ``metrics`` as its bundle holds them (steps -> mae, rmse, r2; samples of each part)."""
    steps = {k: tuple(map(_r4, v)) for k, v in metrics["steps"].items()}
    row = (
        "direct_huber", K.FORECAST_TARGET, model.features, model.features.index(K.FORECAST_TARGET), model.lookback, model.horizon, len(model.features),
        model.penalty, model.rounds, *metrics["samples"], steps["overall"], {k: v for k, v in sorted(steps.items()) if k != "overall"}, scaler_path,
    )
    return spark.createDataFrame([row], TEMP_META)


def write_meta(df: DataFrame, path: str) -> None:
    """Metadata sink: a one-row frame written as a JSON document."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_meta(spark: SparkSession, paths: dict[str, str], strict: bool = True) -> DataFrame:
    """Each model's document (JSON over any number of lines), one row per model: its text, however fields differ
    between documents.  A missing file raises; one that is no JSON object raises too, or with ``strict`` off gives null."""
    frames = []
    for model, path in paths.items():
        text = spark.read.text(path, wholetext=True)
        variant = (F.parse_json if strict else F.try_parse_json)(F.col("value"))
        frames.append(text.where(F.length(F.trim("value")) > 0).select(F.lit(model).alias("model"), F.to_json(variant).alias("meta")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def meta_fields(documents: DataFrame, schema: str, col: str = "meta") -> DataFrame:
    """Documents as typed columns of ``schema`` (a field that one lacks is null), the fields that the schema does
    not know as a map of JSON texts (``other``), and what is no document at all in ``corrupt``."""
    known = F.from_json(F.col(col), f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    rest = F.map_filter(F.from_json(F.col(col), "map<string, string>"), lambda k, _: ~k.isin(names))
    d = documents.withColumns({"_known": known, "other": rest})
    keep = [c for c in documents.columns if c != col]
    return d.select(*keep, *[F.col("_known")[n].alias(n) for n in names if n not in keep], *[F.col("_known")[n].alias(f"meta_{n}") for n in names if n in keep], "other", F.col("_known._corrupt").alias("corrupt"))
