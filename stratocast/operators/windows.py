"""Window operators on the hourly series (lags, rolling means, labels, fills, sequences).

Row semantics follow the original: "n hours back" means n *rows* back in time
order within a location.  All frames run through ``series.framed`` so a location
is split into blocks and no task holds a whole series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..schema import (
    KEY,
    LAG_HOURS,
    RAIN_LOOKAHEAD_H,
    RAIN_THRESHOLD_MM,
    ROLLING_WINDOW,
    TIME,
)
from ..functions.units import nan_to_null
from . import series
from .series import DEFAULT_BLOCK_ROWS, RN


def ensure_index(df: DataFrame, keys=(KEY,), order: str = TIME) -> DataFrame:
    return df if RN in df.columns else series.index_rows(df, keys, order)


# --- expression builders (combine several in one framed pass) ---------------


def lag_exprs(w: WindowSpec, col: str = "temperature", lags: Sequence[int] = LAG_HOURS) -> list[Column]:
    prefix = "temp" if col == "temperature" else col
    return [F.lag(F.col(col), n).over(w).alias(f"{prefix}_lag_{n}") for n in lags]


def rolling_mean_expr(
    w: WindowSpec, col: str = "temperature", window: int = ROLLING_WINDOW, digits: int | None = 4
) -> Column:
    """Trailing mean of ``window`` rows including the current one; null until
    ``window`` non-null values are present (min_periods = window)."""
    frame = w.rowsBetween(-(window - 1), 0)
    mean = F.when(F.count(F.col(col)).over(frame) == window, F.avg(F.col(col)).over(frame))
    if digits is not None:
        mean = F.bround(mean, digits)
    prefix = "temp" if col == "temperature" else col
    return mean.alias(f"{prefix}_rolling_{window}")


def rain_label_expr(
    w: WindowSpec,
    col: str = "precipitation",
    threshold: float = RAIN_THRESHOLD_MM,
    lookahead: int = RAIN_LOOKAHEAD_H,
    tail: str = "zero",
) -> Column:
    """1 when the sum of the next ``lookahead`` rows exceeds ``threshold``.

    A missing row or value in the look-ahead makes the sum unknown; ``tail='zero'``
    turns that into 0 (what the original code does), ``tail='null'`` keeps null.
    """
    frame = w.rowsBetween(1, lookahead)
    value = nan_to_null(F.col(col))  # NaN compares above every threshold
    total = F.sum(value).over(frame)
    complete = F.count(value).over(frame) == lookahead
    raw = F.when(complete, total > F.lit(float(threshold)))
    if tail == "zero":
        raw = F.coalesce(raw, F.lit(False))
    elif tail != "null":
        raise ValueError("tail must be 'zero' or 'null'")
    return raw.cast("int").alias("rain_tomorrow")


def point_label_expr(w: WindowSpec, col: str = "precipitation", ahead: int = 24) -> Column:
    """Older label: the value ``ahead`` rows later is positive (missing -> 0)."""
    return F.coalesce(F.lead(nan_to_null(F.col(col)), ahead).over(w) > F.lit(0.0), F.lit(False)).cast("int").alias(
        "rain_point_24"
    )


# --- operators -------------------------------------------------------------


def add_lag_features(df, col="temperature", lags=LAG_HOURS, block_rows=DEFAULT_BLOCK_ROWS):
    d = ensure_index(df)
    return series.framed(d, lambda w: lag_exprs(w, col, lags), max(lags), 0, block_rows=block_rows)


def add_time_lags(df, col="temperature", hours=LAG_HOURS):
    """Lags by *time* (RANGE semantics): the value exactly ``h`` hours earlier at
    the same location, null when that hour is missing.  Each lag is an equi-join
    on (location, time), so a long series is spread over the join partitions."""
    prefix = "temp" if col == "temperature" else col
    out = df
    for h in hours:
        prev = df.select(
            F.col(KEY).alias("_k"),
            (F.col(TIME) + F.make_dt_interval(F.lit(0), F.lit(h))).alias("_t"),
            F.col(col).alias(f"{prefix}_lag_{h}h"),
        )
        out = out.join(prev, (out[KEY] == prev["_k"]) & (out[TIME] == prev["_t"]), "left").drop("_k", "_t")
    return out


def add_time_features(
    df,
    col="temperature",
    rain="precipitation",
    lags=LAG_HOURS,
    window=ROLLING_WINDOW,
    digits=4,
    threshold=RAIN_THRESHOLD_MM,
    lookahead=RAIN_LOOKAHEAD_H,
    tail="zero",
    block_hours=10_000,
):
    """Lags, rolling mean and forward label by *time*, in one pass: the value exactly ``n`` hours
    earlier (null when that hour is missing), the mean of the last ``window`` hours and the sum of
    the next ``lookahead`` hours (unknown unless every one of those hours has a value).

    Where rows follow each other hour by hour this equals the row mode."""
    h = series.HOUR
    prefix = "temp" if col == "temperature" else col

    def build(w: WindowSpec) -> list[Column]:
        value, amount = nan_to_null(F.col(col)), nan_to_null(F.col(rain))
        past, ahead = w.rangeBetween(-(window - 1) * h, 0), w.rangeBetween(1, lookahead * h)
        mean = F.when(F.count(value).over(past) == window, F.avg(value).over(past))
        total = F.when(F.count(amount).over(ahead) == lookahead, F.sum(amount).over(ahead) > F.lit(float(threshold)))
        if tail == "zero":
            total = F.coalesce(total, F.lit(False))
        elif tail != "null":
            raise ValueError("tail must be 'zero' or 'null'")
        return [
            *[F.max(value).over(w.rangeBetween(-n * h, -n * h)).alias(f"{prefix}_lag_{n}h") for n in lags],
            (mean if digits is None else F.bround(mean, digits)).alias(f"{prefix}_rolling_{window}h"),
            total.cast("int").alias("rain_tomorrow"),
        ]

    return series.framed_time(df, build, max([*lags, window]), lookahead, block_hours=block_hours)


def add_rolling_mean(df, col="temperature", window=ROLLING_WINDOW, digits=4, block_rows=DEFAULT_BLOCK_ROWS):
    d = ensure_index(df)
    return series.framed(
        d, lambda w: [rolling_mean_expr(w, col, window, digits)], window - 1, 0, block_rows=block_rows
    )


def add_rain_label(
    df,
    col="precipitation",
    threshold=RAIN_THRESHOLD_MM,
    lookahead=RAIN_LOOKAHEAD_H,
    tail="zero",
    block_rows=DEFAULT_BLOCK_ROWS,
):
    d = ensure_index(df)
    return series.framed(
        d,
        lambda w: [rain_label_expr(w, col, threshold, lookahead, tail)],
        0,
        lookahead,
        block_rows=block_rows,
    )


def add_point_label(df, col="precipitation", ahead=24, block_rows=DEFAULT_BLOCK_ROWS):
    d = ensure_index(df)
    return series.framed(d, lambda w: [point_label_expr(w, col, ahead)], 0, ahead, block_rows=block_rows)


def add_time_diff(df, block_rows=DEFAULT_BLOCK_ROWS):
    """Hours since the previous row of the location (null on the first row)."""
    d = ensure_index(df)
    return series.framed(
        d,
        lambda w: [
            (F.timestamp_diff("SECOND", F.lag(F.col(TIME), 1).over(w), F.col(TIME)) / F.lit(3600.0)).alias(
                "time_diff_hours"
            )
        ],
        1,
        0,
        block_rows=block_rows,
    )


def autocorrelation(df, col="temperature", max_lag=48, block_rows=DEFAULT_BLOCK_ROWS):
    """Pearson correlation of the series with itself ``l`` rows back, l = 1..max_lag.

    One framed pass puts the ``max_lag`` earlier values of each row in an array;
    ``posexplode`` turns it into (lag, x, y) pairs that feed one grouped
    correlation keyed by (location, lag).  The aggregate combines map-side, so
    the shuffle carries at most locations x max_lag partial rows per task, and
    the generated code holds one correlation, not ``max_lag`` of them.
    """
    d = ensure_index(df)
    lags = list(range(1, max_lag + 1))
    shifted = series.framed(
        d,
        lambda w: [F.array(*[F.lag(F.col(col), n).over(w) for n in lags]).alias("_lags")],
        max_lag,
        0,
        block_rows=block_rows,
    )
    from .eda import safe_corr

    pairs = shifted.select(KEY, F.col(col).alias("_x"), F.posexplode("_lags").alias("_i", "_y"))
    return pairs.groupBy(KEY, (F.col("_i") + F.lit(1)).cast("int").alias("lag")).agg(
        safe_corr(F.col("_x"), F.col("_y")).alias("autocorr")
    )


def interpolate_linear(df, cols: Sequence[str], block_rows=DEFAULT_BLOCK_ROWS, by: str = "row"):
    """Linear interpolation; leading/trailing gaps take the nearest valid value;
    an all-null column stays null.  ``by='row'`` spaces rows equally (the
    original behaviour), ``by='time'`` weights by elapsed time."""
    d = ensure_index(df).withColumns({c: nan_to_null(F.col(c)) for c in cols})
    if by == "time":
        d = d.withColumn("_pos", F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(TIME)))
    elif by != "row":
        raise ValueError("by must be 'row' or 'time'")
    pos_col = "_pos" if by == "time" else RN
    near = series.carry_nearest(d, cols, block_rows=block_rows, pos=pos_col)
    rn = F.col(pos_col)
    out = []
    for c in cols:
        p, n = F.col(f"{c}__prev"), F.col(f"{c}__next")
        slope = (n["v"] - p["v"]) / (n["rn"] - p["rn"]).cast("double")
        filled = (
            F.when(F.col(c).isNotNull(), F.col(c))
            .when(p.isNotNull() & n.isNotNull(), slope * (rn - p["rn"]).cast("double") + p["v"])
            .otherwise(F.coalesce(p["v"], n["v"]))
        )
        out.append(filled.alias(c))
    keep = [x for x in d.columns if x not in cols]
    res = near.select(*keep, *out).select(*d.columns)
    return res.drop("_pos") if by == "time" else res


def fill_forward_backward(df, cols: Sequence[str], block_rows=DEFAULT_BLOCK_ROWS):
    """Forward fill, then backward fill for the leading gap."""
    d = ensure_index(df).withColumns({c: nan_to_null(F.col(c)) for c in cols})
    near = series.carry_nearest(d, cols, block_rows=block_rows)
    keep = [x for x in d.columns if x not in cols]
    filled = [
        F.coalesce(F.col(c), F.col(f"{c}__prev")["v"], F.col(f"{c}__next")["v"]).alias(c) for c in cols
    ]
    return near.select(*keep, *filled).select(*d.columns)


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep one row per ``keys``: the first in ``order``, or in input order where
    ``order`` names no column besides the keys.

    Expressed as an aggregate (min of a struct led by the order columns), so a
    key with a huge number of copies is reduced map-side before any shuffle.
    """
    order = [c for c in order if c not in keys]
    if not order:
        place = "_input_place"
        placed = df.withColumn(place, F.monotonically_increasing_id())
        return dedup_first(placed, keys, [place]).select(*df.columns)
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    return df.groupBy(*[F.col(k) for k in keys]).agg(F.min(packed).alias("_first")).select(
        *keys, *[F.col("_first")[c].alias(c) for c in [*order, *rest]]
    )


def sequences(
    df: DataFrame,
    features: Sequence[str],
    lookback: int = 24,
    horizon: int = 5,
    target: str = "temperature",
    block_rows=DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """Sliding samples: X = the ``lookback`` rows ending at this row (each row an
    array of ``features``), y = ``target`` in the next ``horizon`` rows.
    Rows without a full window on both sides are dropped (n - L - H + 1 per key)."""
    d = ensure_index(df)

    def build(w: WindowSpec) -> list[Column]:
        past = w.rowsBetween(-(lookback - 1), 0)
        ahead = w.rowsBetween(1, horizon)
        row = F.array(*[F.col(f).cast("double") for f in features])
        return [
            F.collect_list(row).over(past).alias("x"),
            F.collect_list(F.col(target).cast("double")).over(ahead).alias("y"),
        ]

    out = series.framed(d, build, lookback - 1, horizon, block_rows=block_rows)
    return out.filter((F.size("x") == lookback) & (F.size("y") == horizon))


def latest_features(df: DataFrame, col: str = "temperature") -> DataFrame:
    """Per location, features of the newest row from the rows before it:
    value 1 and 24 rows back, mean of the 6 rows before (shorter histories fall
    back as the live service does).  Rows are read on the days that hold the
    newest 25 of each location (``series.newest_rows``)."""
    tail = series.newest_rows(df.drop(RN) if RN in df.columns else df, 25)
    b = F.col("_back")
    v = F.col(col)
    agg = tail.groupBy(KEY).agg(
        F.max("_cnt").alias("n_rows"),
        F.max(F.when(b == 0, F.col(TIME))).alias(TIME),
        F.max(F.when(b == 0, v)).alias("temp_now"),
        F.max(F.when(b == 1, v)).alias("_v1"),
        F.max(F.when(b == 24, v)).alias("_v24"),
        F.avg(F.when((b >= 1) & (b <= 6), v)).alias("_m6"),
        F.avg(F.when(b >= 1, v)).alias("_mall"),
    )
    n = F.col("n_rows")
    return agg.select(
        KEY,
        TIME,
        "n_rows",
        "temp_now",
        F.when(n >= 2, F.col("_v1")).otherwise(F.col("temp_now")).alias("temp_lag_1"),
        F.when(n >= 25, F.col("_v24")).otherwise(F.col("temp_now")).alias("temp_lag_24"),
        F.when(n >= 7, F.bround(F.col("_m6"), 4))
        .when(n > 1, F.bround(F.col("_mall"), 4))
        .otherwise(F.col("temp_now"))
        .alias("temp_rolling_6"),
    )


def last_n_rows(df: DataFrame, n: int = 24) -> DataFrame:
    """Keep the newest ``n`` rows of each location, numbered (``_rn``) by their place in all its rows.

    An index carried from an earlier stage may have gaps where rows were filtered
    out, so rows are counted afresh - per day, which also tells the days to read."""
    tail = series.newest_rows(df.drop(RN) if RN in df.columns else df, n)
    return tail.withColumn(RN, F.col("_cnt") - F.col("_back")).drop("_cnt", "_back")
