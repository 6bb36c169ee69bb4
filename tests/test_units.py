"""Unit conversions, rounding parity, bounds and NaN handling."""

import math

from pyspark.sql import functions as F

from stratocast.functions import units
from stratocast.operators import quality


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x double").select(expr(F.col("x")).alias("y")).first().y


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-2.5,)], "x double")
    got = [r.y for r in df.select(F.bround("x", 0).alias("y")).collect()]
    assert got == [2.0, 4.0, -2.0]


def test_kelvin_pressure_precip(spark):
    assert _one(spark, units.kelvin_to_celsius, 300.0) == 26.85
    assert _one(spark, units.pa_to_hpa, 101325.0) == 1013.25
    assert _one(spark, units.metres_to_mm, -0.001) == 0.0
    assert _one(spark, units.metres_to_mm, None) is None


def test_humidity_equal_temps_is_100(spark):
    df = spark.createDataFrame([(20.0, 20.0), (20.0, 30.0)], "t double, td double")
    got = [r.h for r in df.select(units.relative_humidity(F.col("t"), F.col("td")).alias("h")).collect()]
    assert got[0] == 100.0 and got[1] == 100.0  # supersaturated clipped
    raw = df.select(units.relative_humidity(F.col("t"), F.col("td"), clip=False).alias("h")).collect()[1].h
    assert raw > 100.0


def test_wind_speed(spark):
    df = spark.createDataFrame([(3.0, 4.0)], "u double, v double")
    assert df.select(units.wind_speed(F.col("u"), F.col("v")).alias("w")).first().w == 5.0


def test_nan_becomes_null(spark):
    assert _one(spark, units.nan_to_null, float("nan")) is None
    assert _one(spark, units.nan_to_null, 1.5) == 1.5


def test_clip_exact_bounds_and_outside(spark):
    rows = [(-20.0,), (-20.0001,), (60.0,), (60.1,), (None,)]
    df = spark.createDataFrame(rows, "temperature double")
    got = [r.temperature for r in quality.range_clip(df).collect()]
    assert got == [-20.0, -20.0, 60.0, 60.0, None]
    counts = {r.column_name: r.violations for r in quality.range_violations(df).collect()}
    assert counts == {"temperature": 2}


def test_rename_and_parse_time(spark):
    import datetime as dt

    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 18, 30), 300.0)], "Time timestamp_ntz, T2M double")
    d = quality.parse_datetime(quality.rename_known(quality.normalise_headers(df)))
    r = d.first()
    assert set(d.columns) == {"valid_time", "temperature_raw"}
    assert r.valid_time == dt.datetime(2024, 1, 2, 0, 0)  # 18:30 UTC is next day in IST


def test_missing_time_column_raises(spark):
    import pytest

    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(ValueError):
        quality.parse_datetime(df)


def test_required_columns():
    import pytest

    from stratocast.schema import require_columns

    class D:
        columns = ["a"]

    with pytest.raises(ValueError):
        require_columns(D(), ["a", "b"])
    assert math.isfinite(1.0)
