"""Presentation rules of the dashboard and the prediction record (column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as K


def js_round(x: Column) -> Column:
    """JavaScript Math.round: halves go toward +infinity."""
    return F.floor(x + F.lit(0.5))


def confidence(p: Column) -> Column:
    return (
        F.when(p > F.lit(0.75), F.lit(K.CONF_HIGH_RAIN))
        .when(p > F.lit(0.55), F.lit(K.CONF_MEDIUM))
        .when(p < F.lit(0.25), F.lit(K.CONF_HIGH_DRY))
        .otherwise(F.lit(K.CONF_LOW))
    )


def rain_record(p: Column, threshold: Column | float = K.DEFAULT_THRESHOLD) -> Column:
    """struct(rain_tomorrow, probability (4 dp), confidence, threshold_used)."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.struct(
        (p >= thr).alias("rain_tomorrow"),
        F.bround(p, 4).alias("probability"),
        confidence(p).alias("confidence"),
        thr.alias("threshold_used"),
    )


def _cloud_pct(cloud_fraction: Column) -> Column:
    return F.coalesce(cloud_fraction, F.lit(0.0)) * F.lit(100.0)


def weather_icon(precip: Column, cloud_fraction: Column) -> Column:
    p = F.coalesce(precip, F.lit(0.0))
    c = _cloud_pct(cloud_fraction)
    return (
        F.when(p > F.lit(2.0), F.lit(K.ICON_STORM))
        .when(p > F.lit(0.5), F.lit(K.ICON_RAIN))
        .when(c > F.lit(85.0), F.lit(K.ICON_OVERCAST))
        .when(c > F.lit(40.0), F.lit(K.ICON_PARTLY))
        .otherwise(F.lit(K.ICON_CLEAR))
    )


def weather_text(precip: Column, cloud_fraction: Column) -> Column:
    p = F.coalesce(precip, F.lit(0.0))
    c = _cloud_pct(cloud_fraction)
    return (
        F.when(p > F.lit(2.0), F.lit(K.DESC_STORM))
        .when(p > F.lit(0.5), F.lit(K.DESC_RAIN))
        .when(c > F.lit(85.0), F.lit(K.DESC_OVERCAST))
        .when(c > F.lit(60.0), F.lit(K.DESC_MOSTLY))
        .when(c > F.lit(30.0), F.lit(K.DESC_PARTLY))
        .otherwise(F.lit(K.DESC_CLEAR))
    )


def range_position_pct(current: Column, lo: Column, hi: Column) -> Column:
    """Where ``current`` sits in [lo, hi], in percent; 50 when hi <= lo."""
    return F.when(hi > lo, (current - lo) / (hi - lo) * F.lit(100.0)).otherwise(F.lit(50.0))


def clamp_pct(x: Column) -> Column:
    """Within 0 and 100; an unknown value draws an empty bar (``least`` would skip the null)."""
    return F.when(x > F.lit(100.0), F.lit(100.0)).when(x > F.lit(0.0), x).otherwise(F.lit(0.0))


def hydro_bars(humidity: Column, precip: Column, pressure: Column) -> list[Column]:
    return [
        clamp_pct(humidity).alias("humidity_bar"),
        clamp_pct(precip * F.lit(10.0)).alias("precip_bar"),
        clamp_pct((pressure - F.lit(980.0)) / F.lit(60.0) * F.lit(100.0)).alias("pressure_bar"),
    ]


def rain_banner(p: Column, will_rain: Column) -> list[Column]:
    return [
        F.when(will_rain, F.lit("🌧️")).when(p > F.lit(0.35), F.lit("🌤️")).otherwise(F.lit("☀️")).alias("rain_icon"),
        F.when(will_rain, F.lit("Rain expected tomorrow")).otherwise(F.lit("No rain tomorrow")).alias("rain_title"),
        js_round(p * F.lit(100.0)).cast("int").alias("prob_pct"),
    ]


def half_even_int(x: Column) -> Column:
    """Python round(x) to an integer (half to even)."""
    return F.bround(x, 0).cast("int")
