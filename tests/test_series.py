"""Blocked (halo) windows equal the plain per-location window."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratocast.operators import series, windows
from stratocast.plans.features import build_features
from stratocast.sources.tables import load, obs_hourly


def _plain_features(obs, threshold):
    w = Window.partitionBy("location_id").orderBy("valid_time")
    return obs.select(
        "location_id",
        "valid_time",
        F.lag("temperature", 1).over(w).alias("temp_lag_1"),
        F.lag("temperature", 24).over(w).alias("temp_lag_24"),
        F.bround(
            F.when(F.count("temperature").over(w.rowsBetween(-5, 0)) == 6, F.avg("temperature").over(w.rowsBetween(-5, 0))),
            4,
        ).alias("temp_rolling_6"),
        F.coalesce(
            F.when(F.count("precipitation").over(w.rowsBetween(1, 24)) == 24,
                   F.sum("precipitation").over(w.rowsBetween(1, 24)) > threshold),
            F.lit(False),
        ).cast("int").alias("rain_tomorrow"),
    )


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_index_rows_matches_row_number(spark, sf):
    obs = obs_hourly(load(spark, sf, "events"))
    got = series.index_rows(obs).select("location_id", "valid_time", "_rn")
    w = Window.partitionBy("location_id").orderBy("valid_time")
    exp = obs.select("location_id", "valid_time", F.row_number().over(w).alias("_rn"))
    assert _rows(got, got.columns) == _rows(exp, exp.columns)


def test_blocked_features_equal_plain_window(spark, sf):
    obs = obs_hourly(load(spark, sf, "events"))
    cols = ["location_id", "valid_time", "temp_lag_1", "temp_lag_24", "temp_rolling_6", "rain_tomorrow"]
    plain = _rows(_plain_features(obs, 48.0), cols)
    for block in (25, 37, 100_000):
        got = build_features(obs, threshold=48.0, block_rows=block)
        assert _rows(got, cols) == plain, f"block_rows={block}"


def test_interpolation_across_blocks(spark, sf):
    obs = obs_hourly(load(spark, sf, "events")).select("location_id", "valid_time", "humidity")
    ref = windows.interpolate_linear(obs, ["humidity"], block_rows=100_000)
    for block in (3, 10, 64):
        got = windows.interpolate_linear(obs, ["humidity"], block_rows=block)
        cols = ["location_id", "valid_time", "humidity"]
        assert _rows(got, cols) == _rows(ref, cols)


def _series(spark, values, loc=0):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(loc, t0 + dt.timedelta(hours=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "location_id long, valid_time timestamp_ntz, x double")


def test_interpolation_edges_and_middle(spark):
    df = _series(spark, [None, 1.0, None, None, 4.0, None])
    got = [r.x for r in windows.interpolate_linear(df, ["x"]).orderBy("valid_time").collect()]
    assert got == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_interpolation_all_null_column_stays_null(spark):
    df = _series(spark, [None, None, None])
    got = [r.x for r in windows.interpolate_linear(df, ["x"]).collect()]
    assert got == [None, None, None]


def test_fill_forward_then_backward(spark):
    df = _series(spark, [None, 2.0, None, 5.0, None])
    got = [r.x for r in windows.fill_forward_backward(df, ["x"], block_rows=2).orderBy("valid_time").collect()]
    assert got == [2.0, 2.0, 2.0, 5.0, 5.0]


def test_label_tail_zero_and_null(spark):
    df = _series(spark, [2.0] * 30).withColumnRenamed("x", "precipitation")
    zero = [r.rain_tomorrow for r in windows.add_rain_label(df, threshold=1.0).orderBy("valid_time").collect()]
    assert zero[:6] == [1] * 6 and zero[6:] == [0] * 24  # last 24 rows lack a full look-ahead
    null = [r.rain_tomorrow for r in windows.add_rain_label(df, threshold=1.0, tail="null").orderBy("valid_time").collect()]
    assert null[6:] == [None] * 24


def test_single_row_series(spark):
    df = _series(spark, [3.0]).withColumnRenamed("x", "temperature")
    r = windows.add_lag_features(df).collect()[0]
    assert r.temp_lag_1 is None and r.temp_lag_24 is None
    latest = windows.latest_features(df).collect()[0]
    assert latest.temp_lag_1 == 3.0 and latest.temp_rolling_6 == 3.0


def test_dedup_keeps_first_with_tiebreak(spark):
    t = dt.datetime(2024, 1, 1, 5)
    df = spark.createDataFrame(
        [(1, t, 2, 9.0), (1, t, 1, 7.0), (1, t + dt.timedelta(minutes=1), 0, 1.0)],
        "k long, ts timestamp_ntz, id long, v double",
    )
    got = windows.dedup_first(df.withColumn("h", F.lit(0)), ["k", "h"], ["ts", "id"]).collect()
    assert len(got) == 1 and got[0].id == 1 and got[0].v == 7.0


def test_two_locations_are_independent(spark):
    a = _series(spark, [1.0, 2.0, 3.0], loc=0)
    b = _series(spark, [10.0, 20.0], loc=1)
    df = a.unionByName(b).withColumnRenamed("x", "temperature")
    got = {(r.location_id, r.temperature): r.temp_lag_1 for r in windows.add_lag_features(df, lags=[1]).collect()}
    assert got[(1, 10.0)] is None and got[(0, 2.0)] == 1.0 and got[(1, 20.0)] == 10.0


def test_gap_is_row_based(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(0, t0, 1.0), (0, t0 + dt.timedelta(hours=5), 2.0)]
    df = spark.createDataFrame(rows, "location_id long, valid_time timestamp_ntz, temperature double")
    got = sorted((r.valid_time, r.temp_lag_1) for r in windows.add_lag_features(df, lags=[1]).collect())
    assert got[1][1] == 1.0  # previous row, although 5 hours earlier
    gaps = windows.add_time_diff(df).orderBy("valid_time").collect()
    assert gaps[1].time_diff_hours == 5.0


def test_time_lags_and_time_interpolation(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(0, t0, 1.0), (0, t0 + dt.timedelta(hours=1), 2.0), (0, t0 + dt.timedelta(hours=3), 4.0)]
    df = spark.createDataFrame(rows, "location_id long, valid_time timestamp_ntz, temperature double")
    got = {r.valid_time: r.temp_lag_1h for r in windows.add_time_lags(df, hours=[1]).collect()}
    assert got[t0 + dt.timedelta(hours=1)] == 1.0 and got[t0 + dt.timedelta(hours=3)] is None
    rows = [(0, t0, 0.0), (0, t0 + dt.timedelta(hours=1), None), (0, t0 + dt.timedelta(hours=4), 4.0)]
    df = spark.createDataFrame(rows, "location_id long, valid_time timestamp_ntz, x double")
    by_time = [r.x for r in windows.interpolate_linear(df, ["x"], by="time").orderBy("valid_time").collect()]
    by_row = [r.x for r in windows.interpolate_linear(df, ["x"]).orderBy("valid_time").collect()]
    assert by_time == [0.0, 1.0, 4.0] and by_row == [0.0, 2.0, 4.0]


def test_range_reader_equals_full_features(spark, sf):
    from stratocast.plans.features import features_for_range

    obs = obs_hourly(load(spark, "/root/testdata/sf0.01", "events"))
    full = build_features(obs, threshold=48.0).filter(
        (F.col("valid_time") >= F.lit("2024-01-10").cast("timestamp_ntz"))
        & (F.col("valid_time") < F.lit("2024-01-12").cast("timestamp_ntz"))
    )
    part = features_for_range(obs, "2024-01-10", "2024-01-12", threshold=48.0)
    cols = ["location_id", "valid_time", "temp_lag_1", "temp_lag_24", "temp_rolling_6", "rain_tomorrow"]
    assert _rows(part, cols) == _rows(full, cols)


def test_global_time_split(spark, sf):
    from stratocast.operators import splits

    obs = obs_hourly(load(spark, sf, "events")).select("location_id", "valid_time")
    got = splits.time_split(obs, (0.8,), ("train", "test"), keys=())
    rows = sorted((r.valid_time, r.location_id, r.split) for r in got.collect())
    n = len(rows)
    assert [r[2] for r in rows] == ["train"] * int(n * 0.8) + ["test"] * (n - int(n * 0.8))


def test_autocorrelation_matches_brute_force_across_blocks(spark, sf):
    import math

    obs = obs_hourly(load(spark, sf, "events")).select("location_id", "valid_time", "humidity")
    pdf = obs.toPandas().sort_values(["location_id", "valid_time"])
    exp = {}
    for loc, g in pdf.groupby("location_id"):
        s = g["humidity"].reset_index(drop=True)
        for lag in range(1, 6):
            pair = s.to_frame("x").assign(y=s.shift(lag)).dropna()
            c = pair["x"].corr(pair["y"]) if len(pair) > 1 else float("nan")
            exp[(loc, lag)] = None if math.isnan(c) else round(c, 9)
    for block in (7, 100_000):
        got = windows.autocorrelation(obs, "humidity", max_lag=5, block_rows=block).collect()
        res = {(r.location_id, r.lag): None if r.autocorr is None else round(r.autocorr, 9) for r in got}
        assert res == exp, f"block_rows={block}"


def test_last_n_rows_exact_after_rows_removed(spark, sf):
    obs = series.index_rows(obs_hourly(load(spark, sf, "events")))
    # remove the 40 newest rows of every location after indexing: the carried
    # index now has a gap at the top, wider than any fixed slack
    cnt = obs.groupBy("location_id").agg(F.max("_rn").alias("_c"))
    kept = obs.join(cnt, "location_id").filter(F.col("_rn") <= F.col("_c") - 40).drop("_c")
    got = windows.last_n_rows(kept, 24).select("location_id", "valid_time")
    pdf = kept.select("location_id", "valid_time").toPandas()
    exp = sorted(
        (loc, t) for loc, g in pdf.groupby("location_id") for t in g["valid_time"].nlargest(24)
    )
    assert sorted((r.location_id, r.valid_time) for r in got.collect()) == exp
