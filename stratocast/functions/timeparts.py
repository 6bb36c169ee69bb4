"""Time scalar functions: truncation, zone conversion, date parts, cyclic codes, labels.

All work on TIMESTAMP_NTZ wall-clock values, so results do not depend on the
session time zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LOCAL_TZ


def trunc_hour(ts: Column) -> Column:
    """Start of the hour as TIMESTAMP_NTZ (zone independent, unlike date_trunc)."""
    return F.make_timestamp_ntz(
        F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0)
    )


def utc_to_local(ts: Column, tz: str = LOCAL_TZ) -> Column:
    """Read a naive UTC wall clock, convert to ``tz`` and drop the zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts.cast("timestamp_ntz"))


def utc_wall_clock(instant: Column) -> Column:
    """An instant as the naive UTC wall clock (a plain cast would use the session zone)."""
    seconds = (F.unix_micros(instant) / F.lit(1e6)).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def date_parts(ts: Column) -> list[Column]:
    """hour, day, month, day_of_week (0 = Monday)."""
    return [
        F.hour(ts).alias("hour"),
        F.dayofmonth(ts).alias("day"),
        F.month(ts).alias("month"),
        F.weekday(ts).alias("day_of_week"),
    ]


def cyclic(value: Column, period: int, fn: str, digits: int = 6) -> Column:
    """sin/cos of 2*pi*value/period, rounded half-even to ``digits``."""
    angle = F.lit(2 * math.pi) * value / F.lit(period)
    raw = F.sin(angle) if fn == "sin" else F.cos(angle)
    return F.bround(raw, digits)


def cyclic_features(hour: Column, month: Column) -> list[Column]:
    return [
        cyclic(hour, 24, "sin").alias("hour_sin"),
        cyclic(hour, 24, "cos").alias("hour_cos"),
        cyclic(month, 12, "sin").alias("month_sin"),
        cyclic(month, 12, "cos").alias("month_cos"),
    ]


def day_label(day: Column) -> Column:
    """'Mon, May 26' style label of a date."""
    return F.date_format(day, "EEE, MMM dd")


def hour_label(ts: Column, hours_ahead: Column) -> Column:
    """'HH:00' of the wall clock ``hours_ahead`` after ``ts``."""
    shifted = ts + F.make_dt_interval(F.lit(0), hours_ahead.cast("int"))
    return F.concat(F.date_format(shifted, "HH"), F.lit(":00"))
