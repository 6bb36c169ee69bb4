"""Linear fills, null keys and times, NaN, raw cleaning, row-counted halos, metrics at size."""

import time

import pytest
from pyspark.sql import functions as F

from stratocast.functions import presentation as P
from stratocast.operators import metrics as M
from stratocast.operators import quality, series, splits, windows
from stratocast.plans.clean import clean_raw
from stratocast.plans.features import build_features, features_for_range
from stratocast.sources.tables import load, obs_hourly, raw_grid

NAN = float("nan")


def hours(spark, rows, cols="temperature double, precipitation double"):
    df = spark.createDataFrame(rows, f"location_id long, h int, {cols}")
    return df.select("location_id", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("h"))).alias("valid_time"), *[c.split()[0] for c in cols.split(", ")])


def test_null_keys_and_times_are_rows(spark):
    df = hours(spark, [(1, 0, 1.0, 0.0), (None, 1, 2.0, 0.0), (1, None, 3.0, 0.0)])
    out = series.index_rows(df).collect()
    assert len(out) == 3
    assert {(r.location_id, r.temperature): r._rn for r in out} == {(1, 3.0): 1, (1, 1.0): 2, (None, 2.0): 1}
    assert windows.interpolate_linear(df, ["temperature"], block_rows=1).count() == 3
    assert windows.last_n_rows(df, 5).count() == 3
    assert splits.time_split(df).count() == 3


def test_interpolation_is_linear_in_the_rows_of_a_block(spark):
    def run(n):
        df = spark.range(n).select(
            F.lit(1).cast("long").alias("location_id"),
            (F.lit("2000-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("valid_time"),
            F.when(F.col("id") % 7 == 0, F.col("id").cast("double")).alias("temperature"),
        )
        t = time.perf_counter()
        off = windows.interpolate_linear(df, ["temperature"]).agg(F.max(F.abs(F.col("temperature") - F.col("_rn") + 1))).first()[0]
        assert off < 7
        return time.perf_counter() - t

    run(1000)
    small, large = run(50_000), run(100_000)
    assert large < 10 and large < 4 * small + 2


def test_nan_is_unknown(spark):
    rows = [(1, h, 10.0 + h, 0.0) for h in range(30)]
    rows[3] = (1, 3, NAN, NAN)
    df = hours(spark, rows)
    label = windows.add_rain_label(df, lookahead=5, tail="null").collect()
    assert all(r.rain_tomorrow in (0, None) for r in label)
    assert sum(r.rain_tomorrow is None for r in label) == 3 + 5  # the look-ahead of three rows holds it, five run out
    filled = {r.valid_time.hour + 24 * (r.valid_time.day - 1): r.temperature for r in windows.interpolate_linear(df, ["temperature"]).collect()}
    assert filled[3] == 13.0
    assert {r.column_name: r.violations for r in quality.range_violations(df).collect()}["temperature"] == 0
    assert quality.range_clip(df).filter(F.isnan("temperature") | (F.col("temperature") == 60)).count() == 0
    assert quality.nulls_for_nan(df).filter(F.isnan("temperature")).count() == 0


def test_unknown_values_draw_empty_bars(spark):
    df = spark.createDataFrame([(None, None, None), (150.0, 20.0, 2000.0), (-1.0, 0.5, 1010.0)], "h double, p double, s double")
    out = [tuple(r) for r in df.select(*P.hydro_bars(F.col("h"), F.col("p"), F.col("s"))).collect()]
    assert out == [(0.0, 0.0, 0.0), (100.0, 100.0, 100.0), (0.0, 5.0, 50.0)]


def test_auc_of_very_many_rows(spark):
    n = 4_000_000_000
    pts = spark.createDataFrame([(0.9, n, 0, n, n, n, 0), (0.1, 0, n, n, n, n, n)], "score double, pos long, neg long, P long, N long, TP long, FP long")
    assert M.roc_auc(pts).first()[0] == 1.0


def test_raw_rows_without_an_id_are_cleaned(spark, sf):
    raw = raw_grid(load(spark, sf, "events")).drop("event_id")
    raw = raw.toDF(*[f" {c.upper()} " for c in raw.columns])
    out = clean_raw(raw)
    assert out.columns == ["location_id", "valid_time", "temperature", "surface_pressure", "total_cloud_cover", "low_cloud_cover",
                           "medium_cloud_cover", "high_cloud_cover", "precipitation", "humidity", "wind_speed"]
    assert out.count() == out.select("location_id", "valid_time").distinct().count() > 0


def test_first_of_copies_in_input_order(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (2, 5, "c")], "k int, t int, v string").coalesce(1)
    assert sorted(tuple(r) for r in windows.dedup_first(df, ["k", "t"], ["t"]).collect()) == [(1, 5, "b"), (2, 5, "c")]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_offsets_and_instants_keep_their_instant(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [("2024-03-10 07:30:00",), ("2024-03-10T07:30:00Z",), ("2024-03-10 13:00:00+05:30",), ("2024-03-10T02:30:00-05:00",)]
        got = quality.parse_datetime(spark.createDataFrame(rows, "date string")).select(F.col("valid_time").cast("string")).collect()
        assert [r[0] for r in got] == ["2024-03-10 13:00:00"] * 4
        inst = spark.createDataFrame([(1710055800,)], "s long").select(F.timestamp_seconds("s").alias("time"))
        assert quality.parse_datetime(inst).select(F.col("valid_time").cast("string")).first()[0] == "2024-03-10 13:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_pressure_that_is_in_hpa_already(spark):
    df = spark.createDataFrame([(1013.2,)], "surface_pressure_raw double")
    assert quality.convert_units(df, pressure_in_hpa=True).first().surface_pressure == 1013.2


def test_missing_columns_are_an_error(spark):
    with pytest.raises(ValueError, match="humidity"):
        quality.require_columns(spark.range(1), ["id", "humidity"])


def test_features_of_a_range_equal_those_of_the_series(spark, sf):
    obs = obs_hourly(load(spark, sf, "events"))
    span = obs.agg(F.min("valid_time").alias("a"), F.max("valid_time").alias("b")).first()
    lo, hi = (str(span.a + (span.b - span.a) * f) for f in (0.4, 0.6))
    whole = build_features(obs, threshold=48.0).filter((F.col("valid_time") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("valid_time") < F.lit(hi).cast("timestamp_ntz")))
    part = features_for_range(obs, lo, hi, threshold=48.0)
    key = lambda r: (r.location_id, r.valid_time)
    assert sorted(whole.collect(), key=key) == sorted(part.collect(), key=key) and whole.count() > 0


def test_a_broken_store_is_an_error(spark, tmp_path):
    from stratocast.streaming import store

    assert store.read_latest(spark, f"file://{tmp_path}/none", ["location_id", "valid_time"]) is None
    broken = tmp_path / "store" / "log" / "obs_day=2024-01-01" / "batch_id=0"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"not parquet at all")
    with pytest.raises(Exception):
        store.read_latest(spark, f"file://{tmp_path}/store", ["location_id", "valid_time"]).count()


def test_history_is_counted_in_rows_across_gaps(spark, tmp_path):
    from stratocast.streaming import ingest, state

    path, got = f"file://{tmp_path}/obs", {}
    old = hours(spark, [(1, 24 * d, float(d), 0.0) for d in range(40)] + [(2, 0, 7.0, 0.0)])

    def follow():
        state.follow_store(spark, path, old.schema, f"file://{tmp_path}/ckpt", lambda rows, n: got.update({n: rows.collect()}), ["temperature"])

    ingest.versioned_writer(path)(old, 0)
    follow()
    ingest.versioned_writer(path)(hours(spark, [(1, 24 * 40, 40.0, 0.0), (2, 24 * 40, 8.0, 0.0)]), 1)
    follow()
    rows = got[max(got)]
    assert sorted(r.temperature for r in rows if r.location_id == 1)[-26:] == [float(d) for d in range(15, 41)]
    assert sorted(r.temperature for r in rows if r.location_id == 2) == [7.0, 8.0]
    assert {(r.location_id, r.n_rows) for r in rows} == {(1, 41), (2, 2)} and [r.temperature for r in rows if r.touched and r.location_id == 1] == [40.0]
