"""Keyed state of the live path, and compaction of the observation store."""

import os
from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratocast.operators import windows
from stratocast.schema import KEY, TIME
from stratocast.streaming import ingest, state, store

SCHEMA = f"{KEY} long, h long, temperature double"
KEYS = [KEY, TIME]


def hours(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select(KEY, F.timestamp_add("HOUR", "h", F.lit("2024-01-01").cast("timestamp_ntz")).alias(TIME), "temperature")


class Held:
    """One location's state as the state store would hold it."""

    def __init__(self):
        self.value = None

    def get(self):
        return iter(self.value or ()) if not isinstance(self.value, tuple) else self.value

    def put(self, rows):
        self.value = list(rows)

    def update(self, row):
        self.value = row

    def exists(self):
        return self.value is not None


def test_state_is_bounded_and_versions_replace_each_other():
    p = state.RecentRows(["temperature"], state.ROWS_HELD, None)
    p.rows, p.seen = Held(), Held()
    batch = lambda rows: iter([pd.DataFrame(rows, columns=["t", "version", "temperature"])])
    first = next(iter(p.handleInputRows((1,), batch([(t, 0, float(t)) for t in range(500)]), None)))
    assert len(p.rows.value) == state.ROWS_HELD == 28 and first["n_rows"].iloc[0] == 500 and first["touched"].all()
    # a newer version of a held hour, an older one that must not win, and the same again
    for _ in range(2):
        out = next(iter(p.handleInputRows((1,), batch([(499, 2, -1.0), (499, 1, -2.0), (500, 2, float("nan"))]), None)))
    assert out["n_rows"].iloc[0] == 501 and len(p.rows.value) == 28
    assert dict(zip(out["t"], out["temperature"]))[499] == -1.0 and out.loc[out["touched"], "t"].tolist() == [499, 500]
    late = next(iter(p.handleInputRows((1,), batch([(499, 0, 5.0)]), None)))
    assert dict(zip(late["t"], late["temperature"]))[499] == -1.0
    assert p.rows.value[-1] == (500, 2, None)


def test_live_features_read_new_files_only(spark, tmp_path):
    """Twenty batches, one location young all along: every batch reads its own rows, a replayed one changes nothing."""
    log, out, ckpt = (f"file://{tmp_path}/{x}" for x in ("store/log", "out", "ckpt"))
    history, reads = [], []
    schema = hours(spark, [(1, 0, 0.0)]).schema

    def follow():
        q = state.follow_store(spark, log, schema, ckpt, state.feature_writer(out), ["temperature"], ttl=timedelta(days=30))
        reads.append(sum(p["numInputRows"] for p in q.recentProgress))

    for n in range(20):
        rows = [(1, 5 * n + k, float((7 * n + k) % 11)) for k in range(5)] + [(None, 3 * n, float(n))]
        if n in (4, 19):
            rows += [(2, 9, 1.0 + n)]  # seen in two batches: the later version counts
        history += rows
        ingest.versioned_writer(log)(hours(spark, rows), n)
        if n % 4 == 3 or n == 4:
            follow()
    ingest.versioned_writer(log)(hours(spark, rows), 19)  # batch 19 once more
    follow()
    assert reads[0] == 24 and max(reads) <= 25 and sum(reads) == len(history) + len(rows)
    newest = {}
    for loc, h, t in history:
        newest[loc, h] = t
    series = hours(spark, [(loc, h, t) for (loc, h), t in newest.items()])
    want = {r[KEY]: tuple(r)[1:] for r in windows.latest_features(series).select(KEY, TIME, "temp_now", "temp_lag_1", "temp_lag_24", "temp_rolling_6", "n_rows").collect()}
    got = {r[KEY]: tuple(r)[1:] for r in ingest.latest(spark, out, [KEY]).select(KEY, TIME, "temp_now", "temp_lag_1", "temp_lag_24", "temp_rolling_6", "n_rows").collect()}
    assert got == want and want[2][-1] == 1 and want[1][-1] == 100


def test_compaction_keeps_what_readers_see_and_bounds_what_they_open(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    write = ingest.versioned_writer(store.log_of(root))
    newest, opened = {}, []
    read = lambda: {(r[KEY], r[TIME]): r["temperature"] for r in store.read_latest(spark, root, KEYS).collect()}
    for n in range(8):
        rows = [(1, 6 * n + k, float(100 * n + k)) for k in range(8)] + [(2, 0, float(n))]  # hours overlap the next batch's
        write(hours(spark, rows), n)
        for r in hours(spark, rows).collect():
            newest[r[KEY], r[TIME]] = r["temperature"]
        before = read()
        m = store.compact(spark, root, KEYS)
        assert before == newest == read() and m["upto"] == n and m["number"] == n
        assert store.compact(spark, root, KEYS)["number"] == n  # nothing new
        store.vacuum(spark, root)
        assert read() == newest
        opened.append(len({os.path.dirname(f) for f in store.versions(spark, root).inputFiles()}))
    days = 3  # 50 hours
    assert max(opened) <= 2 * days  # a folder a day, and those of the last batch
    assert len(store.manifests(spark, root)) == 2
    # only the day folders asked for are opened
    late = store.read_latest(spark, root, KEYS, since="2024-01-03")
    assert {r[TIME].day for r in late.collect()} == {3} and late.count() == sum(t.day == 3 for _, t in newest)


def test_readers_never_see_half_a_compaction(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    write = ingest.versioned_writer(store.log_of(root))
    write(hours(spark, [(1, 0, 1.0)]), 0)
    store.compact(spark, root, KEYS)
    write(hours(spark, [(1, 0, 2.0), (1, 30, 3.0)]), 1)
    read = lambda: sorted(r["temperature"] for r in store.read_latest(spark, root, KEYS).collect())

    def fails(*_):
        raise OSError("writer lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", fails)
        with pytest.raises(OSError):
            store.compact(spark, root, KEYS)
    assert read() == [2.0, 3.0]  # the files it wrote are not named by a manifest
    assert store.compact(spark, root, KEYS)["number"] == 1 and read() == [2.0, 3.0]
    with pytest.raises(RuntimeError):
        store._publish(spark, root, 1, {"upto": 9, "days": {}})
    assert read() == [2.0, 3.0]


def test_vacuum_leaves_what_a_follower_still_needs(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    write = ingest.versioned_writer(store.log_of(root))
    for n in range(4):
        write(hours(spark, [(1, n, float(n))]), n)
        store.compact(spark, root, KEYS)
    batches = lambda: sorted(os.listdir(f"{tmp_path}/store/log/obs_day=2024-01-01")) if os.path.isdir(f"{tmp_path}/store/log/obs_day=2024-01-01") else []
    store.vacuum(spark, root, followed=0)
    assert batches() == ["batch_id=1", "batch_id=2", "batch_id=3"]
    store.vacuum(spark, root)
    assert batches() == ["batch_id=3"]  # a reader may still hold the manifest before the last
    assert store.read_latest(spark, root, KEYS).count() == 4
