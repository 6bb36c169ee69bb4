"""Direct multi-step temperature forecaster, fitted by distributed normal equations.

A sample is the last ``lookback`` rows of a location (all features, scaled) and the
target of the next ``horizon`` rows.  Samples are never written out: each location is
cut into blocks of consecutive rows (with the rows its windows reach before and after),
one packed matrix a block, and tasks form the windows as views of it.

The Huber loss of all steps is minimised together by reweighted least squares: a round
is one pass over the blocks that adds up, per step, the weighted normal equations of the
lag columns (``lookback`` x features + 1, whatever the number of rows).  Tasks add up
their blocks, their sums are added in groups, and the driver solves the small systems.
The ridge penalty of each step is the one of ``PENALTIES`` with the smallest error on
the validation samples.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as K
from ..schema import KEY, TIME
from . import series, windows
from .scaling import MinMax, fit_minmax
from .series import BLOCK, RN

#: Ridge penalties tried (per sample), and the residual (scaled) from which a sample's weight falls.
PENALTIES, DELTA = (1e-8, 1e-6, 1e-4, 1e-2), 1.0
#: Rounds of reweighting at most, and the change of a coefficient below which they end.
ROUNDS, TOLERANCE = 30, 1e-9
#: Rows of a block.
BLOCK_ROWS = 4_096
_EPOCH = "1970-01-01"


@dataclass
class TempForecaster:
    scaler: MinMax
    coef: list[list[float]]  # per step: lookback x features, then the intercept; scaled
    lookback: int
    horizon: int
    features: list[str]
    penalty: list[float] = field(default_factory=list)
    rounds: int = 0

    def _target(self) -> tuple[float, float]:
        i = self.features.index(K.FORECAST_TARGET)
        s = self.scaler.scale_of(i)
        return s, 0.0 - self.scaler.lo[i] * s

    def predict(self, seq: DataFrame) -> DataFrame:
        """``seq`` has x (lookback arrays of features, unscaled); adds ``pred``: an array of
        ``horizon`` temperatures in degrees C, null where x is null or shorter than the look-back."""
        n = len(self.features)
        scale = [self.scaler.scale_of(i) for i in range(n)]
        off = [0.0 - self.scaler.lo[i] * scale[i] for i in range(n)]
        s, o = self._target()
        flat = F.flatten("x")
        steps = []
        for c in self.coef:
            # scaling folded into the coefficients: one product and sum a step
            w = [c[k] * scale[k % n] for k in range(self.lookback * n)]
            base = c[-1] + math.fsum(c[k] * off[k % n] for k in range(self.lookback * n))
            total = F.aggregate(F.zip_with(flat, F.lit(w), lambda a, b: a * b), F.lit(float(base)), lambda a, b: a + b)
            steps.append((total - F.lit(o)) / F.lit(s))
        return seq.withColumn("pred", F.when(F.size("x") == self.lookback, F.array(*steps)))


def packed_blocks(df: DataFrame, features: Sequence[str], lookback: int, horizon: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block: location, position of its first packed row, of its first and last own row, the location's
    rows ``n``, times (microseconds) and values as packed matrices."""
    d = windows.ensure_index(df)
    count = d.groupBy(KEY).agg(F.max(RN).alias("n"))
    rn = F.col(RN)
    blk = series.block_of(rn, block_rows)
    reach = [blk + F.lit(j) for j in range(-(-(-horizon // block_rows)), -(-(lookback - 1) // block_rows) + 1)]
    lowest, highest = (lambda b: b * block_rows + 1 - (lookback - 1)), (lambda b: (b + 1) * block_rows + horizon)
    near = F.filter(F.array(*reach), lambda b: (b >= 0) & (rn >= lowest(b)) & (rn <= highest(b)))
    micros = F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), F.col(TIME))
    cells = [F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    spread = series.join_null_safe(d, count, [KEY]).select(KEY, RN, "n", micros.alias("t"), *cells, F.explode(near).alias(BLOCK))
    names = [f"f{i}" for i in range(len(features))]

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(RN)
        b, n = int(g[BLOCK].iloc[0]), int(g["n"].iloc[0])
        key = g[KEY].iloc[0]
        return pd.DataFrame({
            KEY: pd.Series([None if pd.isna(key) else int(key)], dtype="Int64"), "first": [int(g[RN].iloc[0])], "low": [b * block_rows + 1],
            "high": [min(n, (b + 1) * block_rows)], "n": [n], "times": [g["t"].to_numpy(np.int64).tobytes()], "data": [g[names].to_numpy(np.float64).tobytes()],
        })

    packed = spread.groupBy(KEY, BLOCK).applyInPandas(pack, f"{KEY} long, first long, low long, high long, n long, times binary, data binary")
    return packed.where("high >= low")


def _samples(row, scaler, lookback: int, horizon: int, target: int, cuts: Sequence[float], part: int | None):
    """Of a packed block: positions, X (with a column of ones) and Y of its samples in one part of the split (None: all)."""
    n_feat = len(scaler[0])
    x = np.frombuffer(row["data"], np.float64).reshape(-1, n_feat) * scaler[0] + scaler[1]
    m = row["n"] - lookback - horizon + 1  # samples of the location
    lo, hi = max(row["low"], lookback), min(row["high"], row["n"] - horizon)
    if part is not None:
        bounds = [0, *(math.floor(m * c) for c in cuts), max(m, 0)]
        lo, hi = max(lo, bounds[part] + lookback), min(hi, bounds[part + 1] + lookback - 1)
    if hi < lo:
        return np.zeros(0, np.int64), np.zeros((0, lookback * n_feat + 1)), np.zeros((0, horizon))
    at = np.arange(lo, hi + 1) - row["first"]
    view = np.lib.stride_tricks.sliding_window_view(x, lookback, axis=0)[at - lookback + 1]  # samples, features, time
    wide = np.concatenate([view.transpose(0, 2, 1).reshape(len(at), -1), np.ones((len(at), 1))], axis=1)
    return at, wide, x[at[:, None] + np.arange(1, horizon + 1), target]


def _sum(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of arrays of ``size`` doubles, one a row: added up in groups, then on the driver."""
    groups = max(1, math.isqrt(rows.rdd.getNumPartitions()))

    def add(it):
        total = np.zeros(size)
        for f in it:
            for b in f["sum"]:
                total += np.frombuffer(b, np.float64)
        yield pd.DataFrame({"sum": [total.tobytes()]})

    dealt = rows.repartition(groups) if groups > 1 else rows.coalesce(1)
    out = np.zeros(size)
    for r in dealt.mapInPandas(add, "sum binary").collect():
        out += np.frombuffer(r["sum"], np.float64)
    return out


def _pass(blocks: DataFrame, size: int, fold) -> np.ndarray:
    """Each task folds its blocks into one array; their sum."""

    def run(it):
        total = np.zeros(size)
        for f in it:
            for row in f.to_dict("records"):
                fold(total, row)
        yield pd.DataFrame({"sum": [total.tobytes()]})

    return _sum(blocks.select("first", "low", "high", "n", "data").mapInPandas(run, "sum binary"), size)


def fit_temp_forecaster(
    blocks: DataFrame,
    scaler: MinMax,
    features: Sequence[str] = K.FORECAST_FEATURES,
    lookback: int = K.LOOKBACK,
    horizon: int = K.FORECAST_N,
    fractions: tuple[float, float] = (0.7, 0.85),
    penalties: Sequence[float] = PENALTIES,
    delta: float = DELTA,
    rounds: int = ROUNDS,
) -> TempForecaster:
    """Fit on ``packed_blocks`` (written once: every round reads them): samples before the first fraction of
    each location train, those up to the second pick the penalty."""
    features = list(features)
    p, target = lookback * len(features) + 1, features.index(K.FORECAST_TARGET)
    scale = np.array([scaler.scale_of(i) for i in range(len(features))])
    scaled = (scale, np.array([0.0 - lo * s for lo, s in zip(scaler.lo, scale)]))
    cell = p * p + p

    def normal(beta):
        """Weighted normal equations of every step at ``beta`` (None: weights of one), and the samples."""

        def fold(total, row):
            _, x, y = _samples(row, scaled, lookback, horizon, target, fractions, 0)
            total[-1] += len(x)
            for h in range(horizon):
                part = total[h * cell : (h + 1) * cell]
                if beta is None:
                    w = x
                else:
                    r = np.abs(y[:, h] - x @ beta[h])
                    w = x * np.minimum(1.0, delta / np.maximum(r, 1e-300))[:, None]
                if beta is not None or h == 0:
                    part[: p * p] += (w.T @ x).ravel()
                part[p * p :] += w.T @ y[:, h]

        total = _pass(blocks, horizon * cell + 1, fold)
        n = total[-1]
        parts = [total[h * cell : (h + 1) * cell] for h in range(horizon)]
        first = parts[0][: p * p].reshape(p, p)
        return [((q[: p * p].reshape(p, p) if beta is not None else first), q[p * p :]) for q in parts], n

    ridge = np.eye(p)
    ridge[-1, -1] = 0  # the intercept is free

    def solve(systems, n, penalty):
        return np.array([np.linalg.lstsq(g + penalty * n * ridge, b, rcond=None)[0] for g, b in systems])

    # per penalty its own rounds: weights depend on the residuals of that fit
    systems, n = normal(None)
    if not n:
        raise ValueError("no location has a whole training sample")
    every = np.stack([solve(systems, n, penalty) for penalty in penalties])  # penalties, steps, columns

    def beyond(total, row):
        _, x, y = _samples(row, scaled, lookback, horizon, target, fractions, 0)
        total[:] += (np.abs(y[None] - np.einsum("nc,phc->pnh", x, every)) > delta).sum((1, 2))

    # where every residual is within delta the weights are one and the fit is done
    heavy, most = _pass(blocks, len(every), beyond), 1
    for k in np.flatnonzero(heavy).tolist():
        penalty, beta, done = penalties[k], every[k], 1
        while done < rounds:
            again = solve(normal(beta)[0], n, penalty)
            done += 1
            moved = np.abs(again - beta).max()
            beta = again
            if moved < TOLERANCE:
                break
        every[k] = beta
        most = max(most, done)

    def error(total, row):
        _, x, y = _samples(row, scaled, lookback, horizon, target, fractions, 1)
        total[:] += np.abs(y[None] - np.einsum("nc,phc->pnh", x, every)).sum(1).ravel()

    wrong = _pass(blocks, len(every) * horizon, error).reshape(len(every), horizon)
    best = wrong.argmin(0)  # the first, and smallest, of equal ones
    coef = [every[k, h].tolist() for h, k in enumerate(best.tolist())]
    return TempForecaster(scaler, coef, lookback, horizon, features, [float(penalties[k]) for k in best.tolist()], most)


def predicted_samples(blocks: DataFrame, model: TempForecaster, fractions: tuple[float, float] = (0.7, 0.85), part: int | None = 2) -> DataFrame:
    """Location, time of the newest input row, step, truth and prediction (degrees C) of every sample of
    one part of the split (0 train, 1 validation, 2 test; None: all)."""
    n = len(model.features)
    scale = np.array([model.scaler.scale_of(i) for i in range(n)])
    scaled = (scale, np.array([0.0 - lo * s for lo, s in zip(model.scaler.lo, scale)]))
    target, coef, (s, o) = model.features.index(K.FORECAST_TARGET), np.array(model.coef), model._target()
    lookback, horizon = model.lookback, model.horizon

    def run(it):
        for f in it:
            for row in f.to_dict("records"):
                at, x, y = _samples(row, scaled, lookback, horizon, target, fractions, part)
                if len(at):
                    t = np.frombuffer(row["times"], np.int64)[at]
                    key = row[KEY]
                    yield pd.DataFrame({
                        KEY: pd.Series([None if pd.isna(key) else int(key)] * (len(at) * horizon), dtype="Int64"), "t": np.repeat(t, horizon), "step": np.tile(np.arange(1, horizon + 1, dtype=np.int32), len(at)),
                        "y_true": ((y - o) / s).ravel(), "y_pred": ((x @ coef.T - o) / s).ravel(),
                    })

    out = blocks.mapInPandas(run, f"{KEY} long, t long, step int, y_true double, y_pred double")
    return out.select(KEY, F.timestamp_add("MICROSECOND", F.col("t"), F.lit(_EPOCH).cast("timestamp_ntz")).alias(TIME), "step", "y_true", "y_pred")


def fit_scaler(df: DataFrame, features: Sequence[str] = K.FORECAST_FEATURES, fit_on: str = "all", lookback: int = K.LOOKBACK, horizon: int = K.FORECAST_N, train: float = 0.7) -> MinMax:
    """Min-max scaler of the features over all rows (as the original does) or over the rows that
    training samples hold (``fit_on='train'``)."""
    if fit_on == "all":
        return fit_minmax(df, features)
    if fit_on != "train":
        raise ValueError("fit_on must be 'all' or 'train'")
    d = windows.ensure_index(df)
    count = d.groupBy(KEY).agg(F.max(RN).alias("_n"))
    samples = F.col("_n") - (lookback + horizon - 1)
    last = F.floor(samples * F.lit(train)) + (lookback - 1) + horizon
    held = series.join_null_safe(d, count, [KEY]).filter((F.floor(samples * F.lit(train)) > 0) & (F.col(RN) <= last))
    return fit_minmax(held, features)


def newest_windows(df: DataFrame, features: Sequence[str] = K.FORECAST_FEATURES, lookback: int = K.LOOKBACK) -> DataFrame:
    """Per location its newest time and the last ``lookback`` rows (x), fewer where it has fewer."""
    tail = windows.last_n_rows(df, lookback)
    row = F.struct(F.col(TIME), F.array(*[F.col(f).cast("double") for f in features]).alias("v"))
    # at most `lookback` rows a location
    held = tail.groupBy(KEY).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    return held.select(KEY, F.element_at("_rows", -1)[TIME].alias(TIME), F.transform("_rows", lambda r: r["v"]).alias("x"))


# what workers run here they get with the task: they need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
