"""The forecaster against a solver that holds all samples at once, and the metadata documents."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocast.operators import forecast, splits, windows
from stratocast.schema import KEY, TIME
from stratocast.session import checkpoint, shared_path
from stratocast.sources import payloads

FEATS = ["temperature", "a", "b"]
LOOK, AHEAD = 4, 2


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for loc, n in ((1, 90), (2, 61), (3, LOOK + AHEAD), (4, LOOK + AHEAD - 1), (5, 1), (None, 40)):
        t = np.cumsum(rng.normal(size=n))
        for i in range(n):
            spike = 40.0 if rng.random() < 0.05 else 0.0
            out.append((loc, int(i), float(t[i] + spike), float(rng.normal()), 3.0))
    df = spark.createDataFrame(out, f"{KEY} long, i long, temperature double, a double, b double")
    return df.select(KEY, F.timestamp_add("HOUR", "i", F.lit("2024-01-01").cast("timestamp_ntz")).alias(TIME), *FEATS).transform(checkpoint)


def samples(rows, scaler):
    """(part, X with ones, Y) of all samples, from the operator that writes sequences out."""
    seq = windows.sequences(rows, FEATS, LOOK, AHEAD)
    part = splits.time_split(seq.drop("_rn"), (0.7, 0.85), ("train", "val", "test")).collect()
    scale = np.array([scaler.scale_of(i) for i in range(len(FEATS))])
    off = -np.array(scaler.lo) * scale
    x = np.array([np.append((np.array(r["x"]) * scale + off).ravel(), 1.0) for r in part])
    y = np.array([np.array(r["y"]) * scale[0] + off[0] for r in part])
    return np.array([r["split"] for r in part]), x, y, [(r[KEY], r[TIME]) for r in part]


@pytest.mark.parametrize("delta", [1.0, 0.02])
@pytest.mark.parametrize("block", [7, 4096])
def test_fit_is_the_optimum_of_the_penalised_huber_loss(rows, delta, block):
    scaler = forecast.fit_scaler(rows, FEATS)
    blocks = forecast.packed_blocks(rows, FEATS, LOOK, AHEAD, block).transform(checkpoint)
    penalties = (1e-6, 1e-2)
    m = forecast.fit_temp_forecaster(blocks, scaler, FEATS, LOOK, AHEAD, penalties=penalties, delta=delta, rounds=400)
    part, x, y, _ = samples(rows, scaler)
    tx, ty, vx, vy = x[part == "train"], y[part == "train"], x[part == "val"], y[part == "val"]

    def solve(h, penalty):
        beta, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
        ridge[-1, -1] = 0
        for _ in range(2000):
            w = np.minimum(1, delta / np.maximum(np.abs(ty[:, h] - tx @ beta), 1e-300))[:, None]
            beta = np.linalg.lstsq((w * tx).T @ tx + penalty * len(tx) * ridge, (w * tx).T @ ty[:, h], rcond=None)[0]
        return beta

    for h in range(AHEAD):
        fits = [solve(h, p) for p in penalties]
        errors = [np.abs(vy[:, h] - vx @ b).sum() for b in fits]
        best = int(np.argmin(errors))
        assert m.penalty[h] == penalties[best]
        got = np.array(m.coef[h])
        assert np.abs(tx @ got - tx @ fits[best]).max() < 1e-5  # coefficients of the constant column are not unique
        r = ty[:, h] - tx @ got
        slope = tx.T @ np.clip(r, -delta, delta) - penalties[best] * len(tx) * np.append(got[:-1], 0)
        assert np.abs(slope).max() < 1e-4
    assert (m.rounds > 1) == (delta < 1)


def test_predictions_of_blocks_and_of_written_windows_agree(rows):
    scaler = forecast.fit_scaler(rows, FEATS)
    blocks = forecast.packed_blocks(rows, FEATS, LOOK, AHEAD, 9).transform(checkpoint)
    m = forecast.fit_temp_forecaster(blocks, scaler, FEATS, LOOK, AHEAD)
    seq = windows.sequences(rows, FEATS, LOOK, AHEAD)
    want = {(r[KEY], r[TIME], h + 1): (r["y"][h], p) for r in m.predict(seq).collect() for h, p in enumerate(r["pred"])}
    got = {(r[KEY], r[TIME], r["step"]): (r["y_true"], r["y_pred"]) for r in forecast.predicted_samples(blocks, m, part=None).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-8) for k in want)
    part, _, _, keys = samples(rows, scaler)
    for p, name in enumerate(("train", "val", "test")):
        held = {(r[KEY], r[TIME]) for r in forecast.predicted_samples(blocks, m, part=p).collect()}
        assert held == {k for k, s in zip(keys, part) if s == name}
    newest = {r[KEY]: r for r in m.predict(forecast.newest_windows(rows, FEATS, LOOK)).collect()}
    assert set(newest) == {1, 2, 3, 4, 5, None}
    assert newest[5]["pred"] is None and len(newest[5]["x"]) == 1 and len(newest[1]["pred"]) == AHEAD


def test_scaler_on_training_rows_sees_no_later_row(rows):
    every, train = forecast.fit_scaler(rows, FEATS), forecast.fit_scaler(rows, FEATS, "train", LOOK, AHEAD)
    part, _, _, keys = samples(rows, every)
    last = {}
    for (k, t), s in zip(keys, part):
        if s == "train":
            last[k] = max(t, last.get(k, t))
    held = [r for r in rows.collect() if r[KEY] in last and (r[TIME] - last[r[KEY]]).total_seconds() <= 3600 * AHEAD]
    for i, f in enumerate(FEATS):
        assert (train.lo[i], train.hi[i]) == (min(r[f] for r in held), max(r[f] for r in held))
    assert every != train
    with pytest.raises(ValueError):
        forecast.fit_scaler(rows, FEATS, "test")


def test_no_sample_is_an_error(spark, rows):
    few = rows.where(f"{KEY} = 5")
    blocks = forecast.packed_blocks(few, FEATS, LOOK, AHEAD)
    with pytest.raises(ValueError):
        forecast.fit_temp_forecaster(blocks, forecast.fit_scaler(few, FEATS), FEATS, LOOK, AHEAD)


def test_documents_round_trip_whatever_their_fields(spark):
    class Fitted:
        features, best_iteration = ["x", "y"], 7

    metrics = {"train_rows": 10, "test_rows": 3, "roc_auc": 0.91234567, "avg_precision": 0.8, "at_0_5": [0.9, 0.8], "at_best": [0.91, None]}
    cv = {m: (0.5, 0.1) for m in ("accuracy", "f1", "roc_auc")}
    doc = payloads.rain_meta(spark, Fitted, 0.35, metrics, cv, {"x": 1.5, "y": 2.25})
    paths = {"rain": shared_path(spark, "doc"), "old": shared_path(spark, "doc"), "none": shared_path(spark, "doc")}
    payloads.write_meta(doc, paths["rain"])
    old = {"model": "older", "best_epoch": 39, "lstm_units": [64, 32], "roc_auc": 0.5, "feature_importance_gain": {"z": 1}}
    spark.createDataFrame([(json.dumps(old, indent=2),)], "value string").coalesce(1).write.text(paths["old"])
    spark.createDataFrame([("[no document",)], "value string").coalesce(1).write.text(paths["none"])
    with pytest.raises(Exception):
        payloads.read_meta(spark, paths).collect()
    back = payloads.read_meta(spark, paths, strict=False)
    got = {r["model"]: r for r in payloads.meta_fields(back, payloads.RAIN_META).collect()}
    assert got["rain"]["feature_importance_gain"] == {"y": 2.25, "x": 1.5} and got["rain"]["hyperparameters"]["n_estimators"] == 300
    assert got["rain"]["metrics_at_best_threshold"].asDict() == {"threshold": 0.35, "accuracy": 0.91, "f1_score": None}
    assert got["rain"]["roc_auc"] == 0.9123 and got["rain"]["cv_results"]["std_f1"] == 0.1 and got["rain"]["other"] == {}
    fields = json.loads(back.where("model = 'rain'").first()["meta"])
    assert len(fields) == 14 and fields["features"] == ["x", "y"]
    assert got["old"]["meta_model"] == "older" and got["old"]["train_rows"] is None and got["old"]["feature_importance_gain"] == {"z": 1.0}
    assert set(got["old"]["other"]) == {"best_epoch", "lstm_units"} and json.loads(got["old"]["other"]["lstm_units"]) == [64, 32]
    assert got["none"]["meta_model"] is None and back.where("model = 'none'").first()["meta"] is None
