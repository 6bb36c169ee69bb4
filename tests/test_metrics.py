"""Metrics against brute-force definitions on small fixtures."""

import random

from pyspark.sql import functions as F

from stratocast.operators import metrics as M


def _frame(spark, pairs):
    return spark.createDataFrame(pairs, "y_true int, y_prob double")


def _brute_auc(pairs):
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def _brute_ap(pairs):
    thresholds = sorted({p for _, p in pairs}, reverse=True)
    P = sum(y for y, _ in pairs)
    ap, prev_r = 0.0, 0.0
    for t in thresholds:
        tp = sum(1 for y, p in pairs if p >= t and y == 1)
        fp = sum(1 for y, p in pairs if p >= t and y == 0)
        r = tp / P
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap


def test_auc_and_ap_match_brute_force(spark):
    rnd = random.Random(7)
    pairs = [(rnd.randint(0, 1), rnd.randint(0, 40) / 40) for _ in range(300)]
    pts = M.score_points(_frame(spark, pairs), buckets=8)
    auc = M.roc_auc(pts).first().roc_auc
    ap = M.average_precision(pts).first().average_precision
    assert abs(auc - _brute_auc(pairs)) < 1e-12
    assert abs(ap - _brute_ap(pairs)) < 1e-12


def test_best_threshold_ties_pick_lowest(spark):
    # every threshold up to 0.3 gives the same predictions -> same F1
    pairs = [(1, 0.95), (0, 0.05), (1, 0.96), (0, 0.02)]
    best = M.best_threshold(M.threshold_sweep(_frame(spark, pairs))).first()
    assert best.best_threshold == 0.1 and best.best_f1 == 1.0


def test_all_negative_truth_defaults_to_half(spark):
    pairs = [(0, 0.9), (0, 0.2), (0, 0.6)]
    best = M.best_threshold(M.threshold_sweep(_frame(spark, pairs))).first()
    assert best.best_threshold == 0.5 and best.best_f1 == 0.0


def test_sweep_grid_matches_numpy_arange():
    import numpy as np

    assert M.SWEEP == list(np.arange(0.10, 0.91, 0.05))


def test_threshold_boundary_is_inclusive(spark):
    pairs = [(1, 0.25), (0, 0.75), (1, 0.55)]
    s = {r.threshold: r for r in M.threshold_sweep(_frame(spark, pairs)).collect()}
    # 0.25 >= 0.25000000000000006 is false: numpy's grid value is slightly above 0.25
    assert s[0.25].recall < 0.9


def test_calibration_right_closed_bins(spark):
    pairs = [(1, 0.1), (0, 0.1000001), (1, 0.0), (1, 1.0)]
    got = {r.bin: r.n for r in M.calibration(_frame(spark, pairs)).collect()}
    assert got == {0: 2, 1: 1, 9: 1}


def test_confusion_and_report(spark):
    pairs = [(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1)]
    c = M.confusion(_frame(spark, pairs)).first()
    assert (c.tp, c.fp, c.fn, c.tn) == (1, 1, 1, 1) and c.accuracy == 0.5 and c.f1 == 0.5
    rep = {r.label: r for r in M.class_report(_frame(spark, pairs)).collect()}
    assert rep[1].precision == 0.5 and rep[0].support == 2


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 3.0), (2, 2.0, 0.0)], "step int, y_true double, y_pred double")
    got = {r.step: r for r in M.regression_metrics(df).collect()}
    assert got["+1h"].mae == 0.5 and got["overall"].n == 3
    assert abs(got["+1h"].r2 - (1 - 1.0 / 2.0)) < 1e-12


def test_auc_and_ap_with_scores_crowded_near_zero(spark):
    # most distinct scores fall in [0, 0.001): fixed-width bins would put them all
    # in one bin; quantile bins spread them, and the result stays exact
    rnd = random.Random(11)
    pairs = [(int(rnd.random() < 0.1), rnd.randint(0, 5000) / 5e6) for _ in range(900)]
    pairs += [(int(rnd.random() < 0.8), rnd.randint(0, 100) / 100) for _ in range(100)]
    pts = M.score_points(_frame(spark, pairs), buckets=16)
    assert abs(pts.agg(F.sum("pos") + F.sum("neg")).first()[0] - len(pairs)) == 0
    auc = M.roc_auc(pts).first().roc_auc
    ap = M.average_precision(pts).first().average_precision
    assert abs(auc - _brute_auc(pairs)) < 1e-12
    assert abs(ap - _brute_ap(pairs)) < 1e-12
