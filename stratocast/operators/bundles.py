"""Serving bundles: a fitted model with all that scoring needs, saved and loaded together.

A bundle is a folder: the MLlib models in their own format, and ``meta`` as one JSON
row written by Spark, so any file system Spark writes will do.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from .forecast import TempForecaster
from .models import RainModel
from .scaling import MinMax


def _write_meta(spark: SparkSession, meta: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def _read_meta(spark: SparkSession, path: str) -> dict:
    row = spark.read.text(f"{path}/meta").first()
    if row is None:
        raise ValueError(f"no metadata in {path}")
    return json.loads(row["value"])


def save_rain(spark: SparkSession, model: RainModel, threshold: float, path: str, metrics: dict | None = None) -> None:
    """The classifier, its feature order and the tuned threshold."""
    model.model.write().overwrite().save(f"{path}/model")
    meta = {
        "features": model.features,
        "best_iteration": model.best_iteration,
        "iterations_run": model.iterations_run,
        "best_threshold": threshold,
        "metrics": metrics or {},
    }
    _write_meta(spark, meta, path)


def load_rain(spark: SparkSession, path: str) -> tuple[RainModel, float, dict]:
    meta = _read_meta(spark, path)
    model = PipelineModel.load(f"{path}/model")
    return RainModel(model, meta["features"], meta["best_iteration"], meta["iterations_run"]), meta["best_threshold"], meta["metrics"]


def save_forecaster(spark: SparkSession, model: TempForecaster, path: str, metrics: dict | None = None) -> None:
    """The coefficients of every step, the scaler, the window and the horizon."""
    s = model.scaler
    meta = {
        "features": model.features,
        "lookback": model.lookback,
        "forecast_n": model.horizon,
        "coef": model.coef,
        "penalty": model.penalty,
        "rounds": model.rounds,
        "scaler": {"cols": list(s.cols), "lo": list(s.lo), "hi": list(s.hi)},
        "metrics": metrics or {},
    }
    _write_meta(spark, meta, path)


def load_forecaster(spark: SparkSession, path: str) -> tuple[TempForecaster, dict]:
    meta = _read_meta(spark, path)
    s = meta["scaler"]
    scaler = MinMax(tuple(s["cols"]), tuple(s["lo"]), tuple(s["hi"]))
    model = TempForecaster(scaler, meta["coef"], meta["lookback"], meta["forecast_n"], meta["features"], meta["penalty"], meta["rounds"])
    return model, meta["metrics"]
