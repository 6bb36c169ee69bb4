"""Skew-safe row windows over per-location time series.

The original code treats row order as time: ``shift(24)`` means 24 *rows*.  A
plain ``Window.partitionBy('location_id')`` does that, but puts a whole location
into one task; with one location holding a third of all rows that task is the
job.  This module gives the same row semantics in parallel:

1. ``index_rows`` numbers the rows of each location exactly (``_rn``, 1-based)
   from per-(location, day) counts: the counts table is small (one row per
   location-day), its prefix sum gives each day's offset, and ``row_number``
   runs only inside a (location, day) partition.
2. ``framed`` cuts each location into blocks of ``block_rows`` consecutive rows
   and copies the ``back`` last rows of a block into the next block (and the
   ``fwd`` first rows into the previous one) as halo.  Windows then partition by
   (location, block) and, for frames no wider than the halo, give exactly the
   result of the unsplit window.  Halo rows are dropped afterwards.
3. ``carry_nearest`` finds, for every row, the nearest non-null value before and
   after it with unbounded reach: inside the block by window, across blocks from
   a per-block summary table (one row per block) windowed by location.  Both
   directions use running frames (the look-ahead over the descending order), so
   the work is linear in the rows of a block.

Rows with a null key or a null time are rows like any other: a null key is one
series, a null time sorts first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import KEY, TIME
from ..session import checkpoint

RN = "_rn"
BLOCK = "_blk"
DEFAULT_BLOCK_ROWS = 100_000


def _keys(keys: Sequence[str] | str) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that matches null keys with null keys; ``right``'s key columns are dropped."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = c if on is None else on & c
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def index_rows(
    df: DataFrame,
    keys: Sequence[str] | str = (KEY,),
    order: str = TIME,
    tiebreak: Sequence[str] = (),
    bucket: Column | None = None,
) -> DataFrame:
    """Add ``_rn``: 1-based row position within ``keys`` in (order, tiebreak) order.

    ``bucket`` (default: calendar day of ``order``) must be monotone in
    ``order``; each bucket is numbered by one task, so it should stay small.
    """
    ks = _keys(keys)
    bkt = "_bkt"
    b = bucket if bucket is not None else F.to_date(F.col(order))
    d = df.withColumn(bkt, b)
    counts = d.groupBy(*ks, bkt).agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*ks).orderBy(bkt).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *ks, bkt, F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off")
    )
    local = Window.partitionBy(*ks, bkt).orderBy(F.col(order), *[F.col(c) for c in tiebreak])
    return (
        join_null_safe(d, offsets, [*ks, bkt])
        .withColumn(RN, F.col("_off") + F.row_number().over(local))
        .drop(bkt, "_off")
    )


def index_all(
    df: DataFrame, bucket: Column, group: Column, order: str = TIME, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """Add ``_rn``: 1-based position among all rows in (order, tiebreak) order.

    ``bucket`` and ``group`` must be monotone in that order, and a group whole buckets
    (day, say).  Rows are numbered within their bucket, buckets summed up within their
    group and only the groups - one row each - over the table, so no window but that
    over the groups sees more than one group's buckets."""
    d = df.withColumns({"_bkt": bucket, "_grp": group})
    counts = d.groupBy("_grp", "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    groups = counts.groupBy("_grp").agg(F.sum("_cnt").alias("_cnt"))
    before = lambda w: F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("_grp", before(Window.orderBy("_grp")).alias("_goff"))
    offsets = counts.select("_grp", "_bkt", before(Window.partitionBy("_grp").orderBy("_bkt")).alias("_off"))
    offsets = join_null_safe(offsets, groups, ["_grp"]).select("_grp", "_bkt", (F.col("_off") + F.col("_goff")).alias("_off"))
    local = Window.partitionBy("_grp", "_bkt").orderBy(F.col(order), *[F.col(c) for c in tiebreak])
    return (
        join_null_safe(d, offsets, ["_grp", "_bkt"])
        .withColumn(RN, F.col("_off") + F.row_number().over(local))
        .drop("_bkt", "_grp", "_off")
    )


def block_of(rn: Column, block_rows: int) -> Column:
    return F.floor((rn - F.lit(1)) / F.lit(block_rows)).cast("long")


def framed(
    df: DataFrame,
    build: Callable[[WindowSpec], list[Column]],
    back: int,
    fwd: int,
    keys: Sequence[str] | str = (KEY,),
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """Add the window columns ``build(w)`` computed over rows ordered by ``_rn``.

    ``w`` is partitioned by (keys, block); every frame ``build`` uses must reach at
    most ``back`` rows before and ``fwd`` rows after the current row.
    """
    if not (0 <= back <= block_rows and 0 <= fwd <= block_rows):
        raise ValueError("halo wider than a block")
    ks = _keys(keys)
    rn = F.col(RN)
    blk = block_of(rn, block_rows)
    pos = (rn - F.lit(1)) % F.lit(block_rows)
    targets = [blk]
    if back > 0:
        targets.append(F.when(pos >= F.lit(block_rows - back), blk + F.lit(1)))
    if fwd > 0:
        targets.append(F.when((pos < F.lit(fwd)) & (blk > F.lit(0)), blk - F.lit(1)))
    base_cols = df.columns
    spread = df.select(
        "*",
        F.explode(F.filter(F.array(*targets), lambda x: x.isNotNull())).alias(BLOCK),
    ).withColumn("_core", F.col(BLOCK) == blk)
    w = Window.partitionBy(*ks, BLOCK).orderBy(RN)
    return (
        spread.select(*base_cols, "_core", *build(w))
        .filter(F.col("_core"))
        .drop("_core")
    )


_EPOCH = "1970-01-01"
HOUR = 3_600_000_000


def micros(order: str = TIME) -> Column:
    """A wall-clock time as microseconds, for range frames."""
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), F.col(order))


def framed_time(
    df: DataFrame,
    build: Callable[[WindowSpec], list[Column]],
    back_hours: int,
    fwd_hours: int,
    keys: Sequence[str] | str = (KEY,),
    order: str = TIME,
    block_hours: int = 10_000,
) -> DataFrame:
    """Add the window columns ``build(w)`` computed over ranges of time: ``w`` is ordered by
    microseconds (``HOUR`` of them an hour) and partitioned by (keys, block of time).

    No rows are numbered: blocks follow from the time alone, rows within ``back_hours``
    of a block's start (``fwd_hours`` of its end) are copied into it as halo and dropped
    afterwards.  Rows without a time only see each other."""
    if not (0 <= back_hours <= block_hours and 0 <= fwd_hours <= block_hours):
        raise ValueError("halo wider than a block")
    ks, at, size = _keys(keys), "_micros", block_hours * HOUR
    d = df.withColumn(at, micros(order))
    t = F.col(at)
    blk = F.coalesce(F.floor(t / F.lit(size)), F.lit(-(1 << 40))).cast("long")
    place = F.pmod(t, F.lit(size))
    targets = [blk]
    if back_hours:
        targets.append(F.when(place >= F.lit(size - back_hours * HOUR), blk + F.lit(1)))
    if fwd_hours:
        targets.append(F.when(place < F.lit(fwd_hours * HOUR), blk - F.lit(1)))
    spread = d.select("*", F.explode(F.filter(F.array(*targets), lambda x: x.isNotNull())).alias(BLOCK)).withColumn("_core", F.col(BLOCK) == blk)
    w = Window.partitionBy(*ks, BLOCK).orderBy(at)
    return spread.select(*df.columns, "_core", *build(w)).filter(F.col("_core")).drop("_core")


#: Days of kept rows, times keys, up to which their table is broadcast (some 32 bytes each).
KEPT_DAYS = 1_000_000


def newest_days(df: DataFrame, n: int, keys: Sequence[str] | str = (KEY,), order: str = TIME) -> DataFrame:
    """The days that hold the newest ``n`` rows of each key: keys, ``_day``, its rows ``_c``, all rows of the key
    ``_cnt`` and those on newer days ``_newer``; from the key and time columns alone."""
    ks = _keys(keys)
    per_day = df.groupBy(*ks, F.to_date(F.col(order)).alias("_day")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*ks)
    newer = F.coalesce(F.sum("_c").over(w.orderBy(F.col("_day").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per_day.select("*", F.sum("_c").over(w).alias("_cnt"), newer.alias("_newer")).filter(F.col("_newer") < n)


def newest_rows(df: DataFrame, n: int, keys: Sequence[str] | str = (KEY,), order: str = TIME) -> DataFrame:
    """The newest ``n`` rows of each key, with ``_cnt``, the rows it has in all, and ``_back``, 0 for the newest.

    Rows are counted per (key, day) first; rows of days that can't hold a key's newest
    ``n`` go before anything is shuffled (while the table of days is small enough to
    broadcast, which is checked; beyond that in the join)."""
    ks = _keys(keys)
    days = checkpoint(newest_days(df, n, keys, order).drop("_c"))
    small = days.count() <= KEPT_DAYS
    rows = join_null_safe(df.withColumn("_day", F.to_date(F.col(order))), F.broadcast(days) if small else days, [*ks, "_day"])
    back = F.col("_newer") + F.row_number().over(Window.partitionBy(*ks, "_day").orderBy(F.col(order).desc_nulls_last())) - 1
    return rows.withColumn("_back", back).filter(F.col("_back") < n).drop("_day", "_newer")


def carry_nearest(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] | str = (KEY,),
    block_rows: int = DEFAULT_BLOCK_ROWS,
    pos: str = RN,
) -> DataFrame:
    """For each column ``c`` add ``c__prev`` / ``c__next``: struct(rn, v) of the
    nearest non-null value strictly before / after the row (null if none);
    ``rn`` holds the ``pos`` column (row index by default)."""
    ks = _keys(keys)
    rn = F.col(RN)
    d = df.withColumn(BLOCK, block_of(rn, block_rows))

    def pair(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col(pos).alias("rn"), F.col(c).alias("v")))

    summary = d.groupBy(*ks, BLOCK).agg(
        *[F.max(pair(c)).alias(f"{c}__last") for c in cols],
        *[F.min(pair(c)).alias(f"{c}__first") for c in cols],
    )
    wb = Window.partitionBy(*ks).orderBy(BLOCK)
    earlier = wb.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*ks).orderBy(F.col(BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *ks,
        BLOCK,
        *[F.last(f"{c}__last", ignorenulls=True).over(earlier).alias(f"{c}__cin") for c in cols],
        *[F.last(f"{c}__first", ignorenulls=True).over(later).alias(f"{c}__cout") for c in cols],
    )
    w = Window.partitionBy(*ks, BLOCK).orderBy(RN)
    wp = w.rowsBetween(Window.unboundedPreceding, -1)
    # the next value is the last one seen when the block is read backwards: a
    # running frame, where (1, unboundedFollowing) would start anew at every row
    wn = Window.partitionBy(*ks, BLOCK).orderBy(F.col(RN).desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = join_null_safe(d, carry, [*ks, BLOCK], "left").select(
        *df.columns,
        *[
            F.coalesce(F.last(pair(c), ignorenulls=True).over(wp), F.col(f"{c}__cin")).alias(
                f"{c}__prev"
            )
            for c in cols
        ],
        *[
            F.coalesce(F.last(pair(c), ignorenulls=True).over(wn), F.col(f"{c}__cout")).alias(
                f"{c}__next"
            )
            for c in cols
        ],
    )
    return out
