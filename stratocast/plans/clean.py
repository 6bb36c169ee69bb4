"""Raw observations -> clean hourly series (the original cleaning stage order).

rename -> parse time -> units -> de-duplicate -> (continuity report) ->
interpolate -> clip -> final columns.  Interpolation runs after unit
conversion and before clipping, as in the original.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality, windows
from ..operators.series import DEFAULT_BLOCK_ROWS, RN
from ..schema import CLEAN_COLUMNS, KEY, TIME

MEASURES = CLEAN_COLUMNS[1:]


def location_from_grid(df: DataFrame) -> DataFrame:
    """A stable location id from the grid coordinates (lat/lon in 0.25 degree steps)."""
    lat = F.round(F.col("latitude") * 4).cast("long")
    lon = F.round(F.col("longitude") * 4).cast("long")
    return df.withColumn(KEY, lat * F.lit(10000) + lon)


def clean_raw(raw: DataFrame, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Full cleaning of raw reanalysis rows (any header case / spacing)."""
    d = quality.nulls_for_nan(quality.normalise_headers(raw))
    d = quality.rename_known(d)
    d = quality.parse_datetime(d)
    d = quality.convert_units(d)
    if KEY not in d.columns:
        d = location_from_grid(d)
    # the first of rows for one hour, in input order unless an id orders them
    d = windows.dedup_first(d, [KEY, TIME], [c for c in ("event_id",) if c in d.columns])
    return clean_series(d, block_rows=block_rows)


def clean_series(series_df: DataFrame, block_rows: int = DEFAULT_BLOCK_ROWS, keep_index: bool = False) -> DataFrame:
    """Interpolate, clip and order the measurement columns of an hourly series.

    Cleaning keeps every row, so with ``keep_index`` the row index built for the
    interpolation is passed on and the feature stage does not rebuild it.
    """
    present = [c for c in MEASURES if c in series_df.columns]
    filled = windows.interpolate_linear(series_df, present, block_rows=block_rows)
    clipped = quality.range_clip(filled)
    out = quality.select_final_columns(clipped.drop(RN))
    return clipped.select(*out.columns, RN) if keep_index else out
