"""Clean series -> model features in one framed window pass.

Lags, rolling mean and the forward label share one window specification, so
Spark evaluates them in a single Window operator after a single shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeparts import cyclic_features, date_parts
from ..operators import series, windows
from ..operators.series import DEFAULT_BLOCK_ROWS, RN
from ..schema import FEATURE_NOT_NULL, KEY, LAG_HOURS, RAIN_LOOKAHEAD_H, RAIN_THRESHOLD_MM, TIME

FEATURE_ORDER = [
    "hour",
    "day",
    "month",
    "day_of_week",
    "temp_lag_1",
    "temp_lag_24",
    "temp_rolling_6",
    "hour_sin",
    "hour_cos",
    "month_sin",
    "month_cos",
    "rain_tomorrow",
]


def build_features(
    clean: DataFrame,
    threshold: float = RAIN_THRESHOLD_MM,
    lookahead: int = RAIN_LOOKAHEAD_H,
    tail: str = "zero",
    block_rows: int = DEFAULT_BLOCK_ROWS,
    keep_index: bool = False,
) -> DataFrame:
    """Date parts, lag 1/24, rolling-6 mean, cyclic codes and the forward label."""
    d = windows.ensure_index(clean)

    def build(w):
        return [
            *windows.lag_exprs(w),
            windows.rolling_mean_expr(w),
            windows.rain_label_expr(w, threshold=threshold, lookahead=lookahead, tail=tail),
        ]

    framed = series.framed(d, build, 24, lookahead, block_rows=block_rows)
    ts = F.col(TIME)
    out = framed.select("*", *date_parts(ts)).select("*", *cyclic_features(F.col("hour"), F.col("month")))
    base = [c for c in clean.columns if c != RN]
    cols = [*base, *FEATURE_ORDER]
    if keep_index:
        cols.append(RN)
    return out.select(*cols)


def range_halo(clean: DataFrame, lo, hi, back: int, fwd: int) -> tuple:
    """Times between which every location has ``back`` rows before ``lo`` and
    ``fwd`` rows from ``hi`` on, or all it has: gaps move them out.

    Reads the key and time columns only; what is windowed is a table of rows per
    (location, day), and two times reach the driver."""
    day = F.to_date(F.col(TIME))

    def reach(rows: DataFrame, newest_first: bool, need: int):
        per_day = rows.groupBy(KEY, day.alias("_day")).agg(
            F.count(F.lit(1)).alias("_n"), F.min(TIME).alias("_from"), F.max(TIME).alias("_to")
        )
        order = F.col("_day").desc() if newest_first else F.col("_day").asc()
        so_far = F.sum("_n").over(Window.partitionBy(KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        needed = per_day.withColumn("_before", F.coalesce(so_far, F.lit(0))).filter(F.col("_before") < need)
        return needed.agg(F.min("_from").cast("string"), F.max("_to").cast("string")).first()

    first = reach(clean.filter(F.col(TIME) < lo), True, back)[0]
    last = reach(clean.filter(F.col(TIME) >= hi), False, fwd)[1]
    return first, last


def features_for_range(
    clean: DataFrame,
    start: str,
    end: str,
    lookahead: int = RAIN_LOOKAHEAD_H,
    **kw,
) -> DataFrame:
    """Features for ``start <= valid_time < end`` only, equal to those of the whole series.

    Catalyst does not push a filter on the order column below a window, so the
    read is widened on both sides to the times that hold the rows the windows
    reach (24 back, ``lookahead`` ahead - rows, not hours, so gaps don't matter);
    that filter reaches the scan, and the exact range is kept afterwards.
    """
    lo = F.to_timestamp_ntz(F.lit(start))
    hi = F.to_timestamp_ntz(F.lit(end))
    wide = clean.drop(RN) if RN in clean.columns else clean
    first, last = range_halo(wide, lo, hi, max(LAG_HOURS), lookahead)
    if first is not None:
        wide = wide.filter(F.col(TIME) >= F.lit(first).cast("timestamp_ntz"))
    else:
        wide = wide.filter(F.col(TIME) >= lo)
    if last is not None:
        wide = wide.filter(F.col(TIME) <= F.lit(last).cast("timestamp_ntz"))
    else:
        wide = wide.filter(F.col(TIME) < hi)
    feats = build_features(wide, lookahead=lookahead, **kw)
    return feats.filter((F.col(TIME) >= lo) & (F.col(TIME) < hi))


def drop_incomplete(features: DataFrame, subset=None) -> DataFrame:
    """Drop rows with a null in any present feature/label column."""
    cols = [c for c in (subset or FEATURE_NOT_NULL) if c in features.columns]
    return features.na.drop(subset=cols)


def rain_rate_by_month_hour(features: DataFrame) -> DataFrame:
    """Share of hours followed by rain (percent), by month and hour of day."""
    return features.groupBy("month", "hour").agg(
        (F.avg(F.col("rain_tomorrow")) * 100).alias("rain_rate_pct"),
        F.count(F.lit(1)).alias("n_hours"),
    )


__all__ = ["build_features", "drop_incomplete", "rain_rate_by_month_hour", "KEY"]
