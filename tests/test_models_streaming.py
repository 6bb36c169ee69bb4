"""Models (seeded, better than constant), save/load, metadata sink, stream = batch."""

import json

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from stratocast.operators import metrics as M
from stratocast.operators import models, splits
from stratocast.plans.clean import clean_series
from stratocast.plans.features import build_features, drop_incomplete
from stratocast.session import checkpoint, shared_path
from stratocast.sources import payloads
from stratocast.sources.tables import load, obs_hourly


def _feats(spark, sf):
    c = clean_series(obs_hourly(load(spark, "/root/testdata/sf0.01", "events")))
    return drop_incomplete(build_features(c, threshold=48.0)).transform(checkpoint)


def test_rain_model_beats_constant_and_round_trips(spark, sf):
    f = _feats(spark, sf)
    # the stand-in's own label has little to do with its features: a label that follows from them
    middle = f.select(F.percentile_approx(F.col("temp_rolling_6") + F.col("wind_speed"), 0.5)).first()[0]
    f = f.withColumn("rain_tomorrow", (F.col("temp_rolling_6") + F.col("wind_speed") > middle).cast("int"))
    feats = ["temperature", "surface_pressure", "total_cloud_cover", "precipitation", "humidity",
             "wind_speed", "temp_rolling_6", "temp_lag_1", "temp_lag_24"]
    s = splits.time_split(f, (0.8,), ("train", "test"))
    train = s.filter("split = 'train'").drop("split")
    test = s.filter("split = 'test'").drop("split")
    m = models.fit_rain_classifier(train, feats, max_iter=5)
    scored = m.score(test).select(F.col("rain_tomorrow").alias("y_true"), "y_prob")
    auc = M.roc_auc(M.score_points(scored)).first().roc_auc
    assert auc > 0.9
    path = shared_path(spark, "model")
    m.model.write().overwrite().save(path)
    back = PipelineModel.load(path)
    by_row = lambda df: {(r.location_id, r.valid_time): r.probability for r in df.collect()}
    assert by_row(m.model.transform(test)) == by_row(back.transform(test))


def test_boosting_stops_by_the_validation_rows(spark, sf):
    f = _feats(spark, sf).withColumn("rain_tomorrow", (F.col("temp_rolling_6") > 10.0).cast("int"))
    s = splits.time_split(f.select("location_id", "valid_time", "temperature", "temp_rolling_6", "rain_tomorrow"), (0.8,), ("train", "valid"))
    train, valid = (s.filter(F.col("split") == x).drop("split") for x in ("train", "valid"))
    noise = valid.withColumn("rain_tomorrow", (F.xxhash64("valid_time") % 2 == 0).cast("int"))
    m = models.fit_rain_classifier(train, ["temperature", "temp_rolling_6"], valid=noise, max_iter=30)
    assert m.best_iteration < 29  # rows that can't be learnt end it early
    rows = models.importance(m).collect()
    assert [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)
    assert all((r.weight > 0) == (r.importance > 0) == (r.gain > 0) == (r.cover > 0) for r in rows)
    # the model's own description of its trees has the same splits, and no split sees more rows than there are
    text = "".join(t.toDebugString for t in m.model.stages[-1].trees)
    assert {r.feature: r.weight for r in rows} == {f: text.count(f"If (feature {i} ") for i, f in enumerate(m.features)}
    assert all(r.cover <= train.count() for r in rows)


def test_metadata_sink_round_trip(spark):
    df = spark.createDataFrame([(0.9, 186)], "roc_auc double, best_iteration int")
    path = shared_path(spark, "meta")
    payloads.write_meta(df, path)
    got = payloads.read_meta(spark, {"rain": path}).first()
    assert got.model == "rain" and json.loads(got.meta)["best_iteration"] == 186


def test_forecast_rows_reject_long_horizon(spark):
    import pytest

    df = spark.createDataFrame([([1.0] * 5,)], "pred array<double>")
    with pytest.raises(ValueError):
        models.forecast_rows(df, n_hours=6, horizon=5)
    rows = models.forecast_rows(df, n_hours=3).collect()
    assert [r.hour for r in rows] == ["+1h", "+2h", "+3h"]


def test_stream_ingest_equals_batch(spark, sf):
    from stratocast.plans import q_streaming

    got = q_streaming.q_str_ingest(spark, sf)
    exp = obs_hourly(load(spark, sf, "events"))
    g = sorted((r.location_id, r.valid_time, r.n) for r in got.collect())
    e = sorted((r.location_id, r.valid_time, r.n) for r in exp.collect())
    assert g == e


def test_replay_slices_arrive_as_one_batch_each(spark, sf):
    from stratocast.plans import q_streaming
    from stratocast.streaming import ingest

    sink = shared_path(spark, "obs_stream")
    ckpt = shared_path(spark, "ckpt")
    seen = []

    def run_once(src, schema):
        writer = (
            ingest.observation_stream(ingest.file_stream(spark, src, schema))
            .writeStream.outputMode("update")
            .foreachBatch(ingest.versioned_writer(sink))
            .option("checkpointLocation", ckpt)
        )
        q = ingest.start_available_now(spark, writer, skip_empty_batches=True)
        seen.append([p["numInputRows"] for p in q.recentProgress])

    q_streaming.replay(spark, sf, run_once, n_slices=3)
    # every restart resumes from the checkpoint and reads only its own slice
    assert all(len(b) == 1 and b[0] > 0 for b in seen), seen
    assert sum(b[0] for b in seen) == load(spark, sf, "events").count()


def test_bundles_predict_alike_after_loading(spark, sf):
    from stratocast.operators import bundles, forecast, windows
    from stratocast.schema import FORECAST_FEATURES

    f = _feats(spark, sf).filter("location_id < 3").transform(checkpoint)
    feats = ["temperature", "temp_rolling_6", "wind_speed"]
    rain = models.fit_rain_classifier(f, feats, max_iter=3)
    path = shared_path(spark, "rain-bundle")
    bundles.save_rain(spark, rain, 0.35, path, {"roc_auc": 0.9})
    back, threshold, metrics = bundles.load_rain(spark, path)
    key = ["location_id", "valid_time"]
    rows = lambda m: {(r.location_id, r.valid_time): r.y_prob for r in m.score(f).select(*key, "y_prob").collect()}
    assert rows(back) == rows(rain) and (threshold, metrics, back.features) == (0.35, {"roc_auc": 0.9}, feats)

    blocks = forecast.packed_blocks(f, FORECAST_FEATURES, 24, 5).transform(checkpoint)
    temp = forecast.fit_temp_forecaster(blocks, forecast.fit_scaler(f))
    path = shared_path(spark, "temp-bundle")
    bundles.save_forecaster(spark, temp, path, {"mae_celsius": 1.5})
    again, metrics = bundles.load_forecaster(spark, path)
    some = windows.sequences(f, FORECAST_FEATURES, 24, 5).limit(50).transform(checkpoint)
    preds = lambda m: {(r.location_id, r.valid_time): tuple(r.pred) for r in m.predict(some).select(*key, "pred").collect()}
    assert preds(again) == preds(temp)
    short = again.predict(some).select(*key, "pred").unionByName(some.limit(1).select(*key, F.lit(None).cast("array<double>").alias("pred")))
    rec = models.forecast_record(short, metrics["mae_celsius"], n_hours=2).collect()
    assert all(r.n_hours == 2 and r.mae_celsius == 1.5 for r in rec)
    assert [r.rejected is not None for r in rec].count(True) == 1 and all(len(r.forecast) == 2 for r in rec if r.rejected is None)


def test_boosting_outlasts_weak_trees(spark, sf):
    losses = [1.0, 0.9, 0.95, 0.93, 0.8] + [0.85] * 25 + [0.1]
    assert models.best_iteration(losses) == 4  # past two weak trees, not past 20
    assert models.best_iteration(losses, patience=2) == 1

    f = _feats(spark, sf).withColumn("rain_tomorrow", (F.col("temp_rolling_6") > 10.0).cast("int"))
    feats = ["temperature", "temp_rolling_6"]
    s = splits.time_split(f.select("location_id", "valid_time", *feats, "rain_tomorrow"), (0.8,), ("train", "valid"))
    train, valid = (s.filter(F.col("split") == x).drop("split").transform(checkpoint) for x in ("train", "valid"))
    whole = models.fit_rain_classifier(train, feats, max_iter=12)
    va = whole.model.stages[0].transform(valid.withColumn("rain_tomorrow", F.col("rain_tomorrow").cast("double")).withColumn("weight", F.lit(1.0)))
    curve = whole.model.stages[1].evaluateEachIteration(va)
    m = models.fit_rain_classifier(train, feats, valid=valid, max_iter=12, patience=12)
    assert m.best_iteration == curve.index(min(curve)) and m.model.stages[1].getNumTrees == m.best_iteration + 1
    # the kept prefix is the model that a fit of as many trees gives
    again = models.fit_rain_classifier(train, feats, max_iter=m.best_iteration + 1)
    by_row = lambda m: {(r.location_id, r.valid_time): r.y_prob for r in m.score(valid).select("location_id", "valid_time", "y_prob").collect()}
    assert by_row(m) == by_row(again)
    cut = models.first_trees(whole.model.stages[1], 3)
    assert cut.getNumTrees == 3 and list(cut.treeWeights) == list(whole.model.stages[1].treeWeights)[:3]


def test_cross_validation_fits_all_training_rows(spark, sf, monkeypatch):
    f = _feats(spark, sf).filter("location_id < 3")
    feats = ["temperature", "temp_rolling_6"]
    sizes, real = [], models.fit_rain_classifier

    def fit(train, *args, **kw):
        assert kw.get("valid") is None
        sizes.append(train.count())
        return real(train, *args, **kw)

    monkeypatch.setattr(models, "fit_rain_classifier", fit)
    assert models.cross_validate(f, feats, n_splits=2, max_iter=2).count() == 3
    member = splits.fold_membership(f, 2).filter("role = 'train'")
    assert sorted(sizes) == sorted(r["count"] for r in member.groupBy("fold").count().collect())
