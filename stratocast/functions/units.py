"""Unit conversions of raw reanalysis variables (column expressions).

Rounding uses ``bround`` (half-even), the closest built-in to the NumPy rounding
of the original; everything stays a JVM expression inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import KELVIN_OFFSET, MAGNUS_A, MAGNUS_B


def nan_to_null(c: Column) -> Column:
    """Spark orders NaN above every number (so NaN > x is true); use null instead."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def kelvin_to_celsius(k: Column) -> Column:
    return F.bround(k - F.lit(KELVIN_OFFSET), 4)


def pa_to_hpa(p: Column) -> Column:
    return F.bround(p / F.lit(100.0), 2)


def floor_zero(x: Column) -> Column:
    """Lower clip at 0 that keeps null (``greatest`` would skip the null)."""
    return F.when(x < F.lit(0.0), F.lit(0.0)).otherwise(x)


def metres_to_mm(m: Column) -> Column:
    return floor_zero(F.bround(m * F.lit(1000.0), 4))


def relative_humidity(t_c: Column, td_c: Column, clip: bool = True) -> Column:
    """RH % = 100 * exp(a*Td/(b+Td)) / exp(a*T/(b+T)), 2 dp; clipped to 0-100
    in the cleaning path, unclipped in the serving helper."""
    num = F.exp(F.lit(MAGNUS_A) * td_c / (F.lit(MAGNUS_B) + td_c))
    den = F.exp(F.lit(MAGNUS_A) * t_c / (F.lit(MAGNUS_B) + t_c))
    rh = F.lit(100.0) * num / den
    if clip:
        rh = clip_range(rh, 0.0, 100.0)
    return F.bround(rh, 2)


def wind_speed(u: Column, v: Column) -> Column:
    return F.bround(F.sqrt(u * u + v * v), 4)


def percent_to_fraction(p: Column) -> Column:
    return F.bround(p / F.lit(100.0), 4)


def fraction_to_percent(f: Column) -> Column:
    return f * F.lit(100.0)


def clip_range(x: Column, lo: float, hi: float) -> Column:
    """Clip to [lo, hi]; null stays null, NaN (unknown too) becomes null."""
    x = nan_to_null(x)
    return F.when(x < F.lit(lo), F.lit(lo)).when(x > F.lit(hi), F.lit(hi)).otherwise(x)
