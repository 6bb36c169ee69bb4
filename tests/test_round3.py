"""Time-mode windows, day-pruned newest rows, guards and payloads."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from stratocast.operators import joins, series, splits, windows
from stratocast.plans.clean import clean_series
from stratocast.schema import KEY, TIME
from stratocast.sources import files, payloads
from stratocast.sources.tables import load, obs_hourly

T0 = dt.datetime(2024, 1, 1)


def rows(spark, data):
    """(location, hour or None, temperature, precipitation)"""
    return spark.createDataFrame([(k, None if h is None else T0 + dt.timedelta(hours=h), t, p) for k, h, t, p in data], f"{KEY} long, {TIME} timestamp_ntz, temperature double, precipitation double")


@pytest.mark.parametrize("block", [24, 30, 10_000])
def test_time_features_equal_counting_hours(spark, block):
    import random

    rnd = random.Random(block)
    data = [(k, h, rnd.choice([None, float("nan"), *map(float, range(9))]) if rnd.random() < 0.2 else float(rnd.randrange(9)), float(rnd.randrange(4))) for k in (1, None) for h in range(-40, 200) if rnd.random() < 0.93]
    data += [(1, None, 3.0, 1.0)]
    got = windows.add_time_features(rows(spark, data), threshold=40.0, block_hours=block).collect()
    assert len(got) == len(data)
    known = lambda v: v if v is not None and v == v else None
    temp = {(k, h): known(t) for k, h, t, _ in data if h is not None}
    rain = {(k, h): known(p) for k, h, _, p in data if h is not None}
    for r in got:
        if r[TIME] is None:
            continue
        k, h = r[KEY], round((r[TIME] - T0).total_seconds() / 3600)
        past = [temp.get((k, h - i)) for i in range(6)]
        ahead = [rain.get((k, h + i)) for i in range(1, 25)]
        assert (r.temp_lag_1h, r.temp_lag_24h) == (temp.get((k, h - 1)), temp.get((k, h - 24)))
        assert (r.temp_rolling_6h is None) == (None in past) and (None in past or abs(r.temp_rolling_6h - sum(past) / 6) < 1e-4)
        assert r.rain_tomorrow == int(None not in ahead and sum(ahead) > 40.0)


def test_time_mode_equals_row_mode_without_gaps(spark):
    d = rows(spark, [(1, h, float(h % 7), float(h % 5)) for h in range(300)])
    by_time = {r[TIME]: (r.temp_lag_1h, r.temp_lag_24h, r.temp_rolling_6h, r.rain_tomorrow) for r in windows.add_time_features(d, threshold=47.0).collect()}
    lags = windows.add_rain_label(windows.add_rolling_mean(windows.add_lag_features(d)), threshold=47.0)
    assert by_time == {r[TIME]: (r.temp_lag_1, r.temp_lag_24, r.temp_rolling_6, r.rain_tomorrow) for r in lags.collect()}
    with pytest.raises(ValueError):
        windows.add_time_features(d, block_hours=10)


def test_newest_rows_read_only_the_days_that_hold_them(spark):
    data = [(1, h, float(h), 0.0) for h in range(2000)] + [(2, 48 * h, float(h), 0.0) for h in range(30)] + [(3, 5, 1.0, 0.0), (None, 7, 2.0, 0.0), (1, None, 9.0, 0.0), (4, None, 8.0, 0.0)]
    d = rows(spark, data)
    got = {}
    found = series.newest_rows(d, 25)
    for r in found.collect():
        got.setdefault(r[KEY], []).append((r._back, r.temperature, r._cnt))
    assert sorted(got[1]) == [(i, float(1999 - i), 2001) for i in range(25)]
    assert sorted(got[2]) == [(i, float(29 - i), 30) for i in range(25)]
    assert got[3] == [(0, 1.0, 1)] and got[None] == [(0, 2.0, 1)] and got[4] == [(0, 8.0, 1)]
    # rows meet the table of days before they are exchanged for the row numbers
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("Exchange hashpartitioning") < plan.index("BroadcastHashJoin")
    assert series.newest_days(d, 25).agg(F.sum("_c")).first()[0] < 120  # of 2,034 rows


def test_sequence_split_names_the_samples(spark, sf):
    obs = clean_series(obs_hourly(load(spark, sf, "events"))).select(KEY, TIME, "temperature")
    seq = splits.time_split(windows.sequences(obs, ["temperature"], 24, 5).drop("x", "y", "_rn"), (0.7, 0.85), ("train", "val", "test"))
    by = lambda df: {(r[KEY], r[TIME]): r["split"] for r in df.collect()}
    assert by(splits.sequence_split(obs, 24, 5)) == by(seq)


def test_global_order_numbers_all_rows(spark):
    d = rows(spark, [(k, h, 0.0, 0.0) for k in (5, 2000, 1) for h in range(100)])
    got = series.index_all(d, F.struct(F.col(TIME), F.floor(F.col(KEY) / 1024)), F.to_date(F.col(TIME)), tiebreak=[KEY]).collect()
    assert [r["_rn"] for r in sorted(got, key=lambda r: (r[TIME], r[KEY]))] == list(range(1, 301))


def test_merge_by_key_guards_against_repeated_keys(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "k int, v string")
    right = spark.createDataFrame([(1, 10), (2, 20), (2, 21)], "k int, tp int")
    with pytest.raises(Exception, match="more than once: 2"):
        joins.merge_variables(left, right, ["k"]).collect()
    assert sorted(map(tuple, joins.merge_variables(left, right.where("tp < 21"), ["k"]).collect())) == [(1, "a", 10), (1, "b", 10), (2, "c", 20)]
    assert joins.merge_variables(left, right.coalesce(1), ["k"], "first").where("k = 2").first()["tp"] == 20
    assert joins.merge_variables(left, right, ["k"], "all").count() == 4
    with pytest.raises(ValueError):
        joins.merge_variables(left, right, ["k"], "any")


def test_loaders_read_nan_as_null(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.5)], "k int, v double")
    files.write_csv(df, str(tmp_path / "csv"))
    files.write_partitioned(df, str(tmp_path / "p"), ["k"])
    read = [files.read_csv_typed(spark, str(tmp_path / "csv"), df.schema), files.read_partitioned(spark, str(tmp_path / "p"))]
    read.append(files.read_csv_normalised(spark, str(tmp_path / "csv"), {"v": df.schema["v"].dataType}))
    assert all(sorted(str(r["v"]) for r in x.collect()) == ["1.5", "None"] for x in read)


def test_live_payload_sections_defaults_and_corrupt_documents(spark):
    whole = {
        "latitude": 27.7, "unit": {"x": 1},
        "current": {"time": "2024-01-01T05:00", "temperature_2m": 10.0, "surface_pressure": 1001.5, "dewpoint_2m": 10.0, "wind_speed_10m": 3, "cloud_cover": 33.333, "cloud_cover_low": 0, "cloud_cover_mid": None},
        "hourly": {"time": ["2024-01-01T04:00", "2024-01-01T05:00", None], "temperature_2m": [9.0, None, 1.0], "dewpoint_2m": [1.0, 2.0, 3.0]},
        "daily": {"time": ["2024-01-01"], "temperature_2m_min": [1.0], "temperature_2m_max": [12.0]},
    }
    data = [(1, json.dumps(whole)), (2, json.dumps({"hourly": whole["hourly"]})), (3, '{"current": {"temperature_2m": '), (4, None), (5, json.dumps({**whole, "daily": {"temperature_2m_min": []}}))]
    parsed = payloads.parse_live_payloads(spark.createDataFrame(data, f"{KEY} long, payload string"))
    got = {r[KEY]: r for r in payloads.current_conditions(parsed).collect()}
    r = got[1]
    assert (r[TIME], r.temperature, r.precipitation, r.wind_speed, r.humidity) == (dt.datetime(2024, 1, 1, 5), 10.0, 0.0, 3.0, 100.0)
    assert (r.total_cloud_cover, r.low_cloud_cover, r.medium_cloud_cover, r.high_cloud_cover) == (0.3333, 0.0, None, None)
    assert (r.temp_min, r.temp_max, r.hours, r.corrupt) == (1.0, 12.0, 1, None)
    assert got[2].temperature is None and got[2].precipitation is None and got[2].hours is None and got[2].corrupt is None
    assert got[3].corrupt == data[2][1] and got[3].temperature is None and got[4].corrupt is None and got[4].temperature is None
    assert got[5].temp_min is None and got[5].temp_max is None and got[5].temperature == 10.0
