"""Queries: splits, weights, scaling and metrics (ML-1..5, ML-8..12, ML-17..19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import scaling, series, splits, windows
from ..schema import FORECAST_FEATURES, KEY, TIME
from ..sources.tables import STANDIN_RAIN_THRESHOLD, clean_table, load, scored_labels
from . import sqlparts as S
from .catalog import query, r6
from .features import build_features, drop_incomplete

SCORED = S.with_(S.SCORED)
CLEAN = S.with_(S.OBS, S.CLEAN)
CLEAN_FEAT = S.with_(S.OBS, S.CLEAN, S.feat(STANDIN_RAIN_THRESHOLD, source="clean"))
KEPT = ", kept AS (SELECT * FROM feat WHERE temp_lag_1 IS NOT NULL AND temp_lag_24 IS NOT NULL AND temp_rolling_6 IS NOT NULL)\n"


def scored(spark, sf_dir):
    return scored_labels(load(spark, sf_dir, "labels"))


def clean(spark, sf_dir):
    return clean_table(spark, sf_dir)


def kept_features(spark, sf_dir):
    c = clean_table(spark, sf_dir, keep_index=True)
    return drop_incomplete(build_features(c, threshold=STANDIN_RAIN_THRESHOLD))


def _r6_all(df, cols):
    return df.select(*[r6(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


# --- splits and weights ------------------------------------------------------


@query(
    "ml_split_80_20",
    CLEAN
    + """SELECT location_id, valid_time,
       CASE WHEN row_number() OVER w <= floor(count(*) OVER (PARTITION BY location_id) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split
FROM clean WINDOW w AS (PARTITION BY location_id ORDER BY valid_time)""",
)
def q_ml_split_80_20(spark, sf_dir):
    return splits.time_split(clean(spark, sf_dir), (0.8,), ("train", "test")).select(KEY, TIME, "split")


@query(
    "ml_split_70_15_15",
    CLEAN_FEAT
    + KEPT
    + """, s AS (SELECT location_id, valid_time,
              row_number() OVER (PARTITION BY location_id ORDER BY valid_time) - 24 AS i,
              count(*) OVER (PARTITION BY location_id) - 28 AS ns FROM kept)
SELECT location_id, valid_time,
       CASE WHEN i < floor(ns * 0.7::DOUBLE) THEN 'train' WHEN i < floor(ns * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split
FROM s WHERE i >= 0 AND i < ns""",
)
def q_ml_split_70_15_15(spark, sf_dir):
    return splits.sequence_split(kept_features(spark, sf_dir).select(KEY, TIME), 24, 5).select(KEY, TIME, "split")


@query(
    "ml_split_global",
    CLEAN
    + """SELECT location_id, valid_time,
       CASE WHEN row_number() OVER (ORDER BY valid_time, location_id) <= floor(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split
FROM clean""",
)
def q_ml_split_global(spark, sf_dir):
    """One time order over all locations, as a single series has it."""
    return splits.time_split(clean(spark, sf_dir), (0.8,), ("train", "test"), keys=()).select(KEY, TIME, "split")


@query(
    "ml_ts_folds",
    CLEAN
    + """, i AS (SELECT location_id, valid_time, row_number() OVER (PARTITION BY location_id ORDER BY valid_time) AS pos,
              count(*) OVER (PARTITION BY location_id) AS n FROM clean),
f AS (SELECT DISTINCT location_id, n, CAST(k.fold AS INTEGER) AS fold, n // 6 AS ts,
             n - 5 * (n // 6) + (k.fold - 1) * (n // 6) AS st FROM i JOIN range(1, 6) AS k(fold) ON true)
SELECT f.location_id, f.fold, f.st AS train_rows, f.ts AS test_rows,
       max(CASE WHEN i.pos = f.st THEN i.valid_time END) AS train_end,
       max(CASE WHEN i.pos = f.st + 1 THEN i.valid_time END) AS test_start,
       max(CASE WHEN i.pos = f.st + f.ts THEN i.valid_time END) AS test_end
FROM f JOIN i ON i.location_id = f.location_id AND i.pos IN (f.st, f.st + 1, f.st + f.ts)
GROUP BY 1, 2, 3, 4""",
)
def q_ml_ts_folds(spark, sf_dir):
    f = splits.expanding_folds(clean(spark, sf_dir), 5)
    return f.select(KEY, "fold", F.col("train_rows").cast("long").alias("train_rows"),
                    F.col("test_rows").cast("long").alias("test_rows"), "train_end", "test_start", "test_end")


@query(
    "ml_balanced_weights",
    """WITH c AS (SELECT quality, count(*) AS nc FROM labels GROUP BY 1),
t AS (SELECT sum(nc) AS n, count(*) AS k FROM c)
SELECT l.doc_id, l.quality, round(t.n / (t.k * c.nc), 6) AS weight FROM labels l JOIN c ON c.quality = l.quality, t""",
)
def q_ml_balanced_weights(spark, sf_dir):
    w = splits.balanced_weights(load(spark, sf_dir, "labels").select("doc_id", "quality"), "quality")
    return w.select("doc_id", "quality", r6(F.col("weight")).alias("weight"))


# --- scaling -------------------------------------------------------------------

_SCALE = FORECAST_FEATURES


def _scale_sql(c):
    s = f"(1.0::DOUBLE / CASE WHEN (m.hi_{c} - m.lo_{c}) <> 0 THEN (m.hi_{c} - m.lo_{c}) ELSE 1.0::DOUBLE END)"
    return s, f"(0.0::DOUBLE - m.lo_{c} * {s})"


_MM = (
    CLEAN_FEAT
    + KEPT
    + ", m AS (SELECT "
    + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in _SCALE)
    + " FROM kept)\n"
)


@query(
    "ml_minmax",
    _MM
    + "SELECT k.location_id, k.valid_time, "
    + ", ".join(f"round(k.{c} * {_scale_sql(c)[0]} + {_scale_sql(c)[1]}, 6) AS {c}" for c in _SCALE)
    + " FROM kept k, m",
)
def q_ml_minmax(spark, sf_dir):
    k = kept_features(spark, sf_dir).select(KEY, TIME, *_SCALE)
    mm = scaling.fit_minmax(k, _SCALE)
    return _r6_all(mm.transform(k), _SCALE)


@query(
    "ml_minmax_inverse",
    _MM
    + f"""SELECT k.location_id, k.valid_time, k.temperature,
       round(((k.temperature * {_scale_sql('temperature')[0]} + {_scale_sql('temperature')[1]})
              - {_scale_sql('temperature')[1]}) / {_scale_sql('temperature')[0]}, 6) AS temperature_restored
FROM kept k, m""",
)
def q_ml_minmax_inverse(spark, sf_dir):
    k = kept_features(spark, sf_dir).select(KEY, TIME, *_SCALE)
    mm = scaling.fit_minmax(k, _SCALE)
    s = mm.transform(k.withColumn("_t", F.col("temperature")), suffix="_s")
    back = mm.inverse(s, "temperature_s", "temperature", "temperature_restored")
    return back.select(KEY, TIME, F.col("_t").alias("temperature"),
                       r6(F.col("temperature_restored")).alias("temperature_restored"))


# --- classification metrics ------------------------------------------------------

_CM = """cm AS (SELECT count(*) FILTER (WHERE y_true = 1 AND y_prob >= 0.5) AS tp, count(*) FILTER (WHERE y_true <> 1 AND y_prob >= 0.5) AS fp,
                   count(*) FILTER (WHERE y_true = 1 AND y_prob < 0.5) AS fn, count(*) FILTER (WHERE y_true <> 1 AND y_prob < 0.5) AS tn FROM scored)"""


@query(
    "ml_confusion",
    S.with_(S.SCORED, _CM)
    + """SELECT tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6) AS f1 FROM cm""",
)
def q_ml_confusion(spark, sf_dir):
    return _r6_all(M.confusion(scored(spark, sf_dir)), ["accuracy", "f1"])


def _report_sql(label, hit, fpos, miss):
    prec = f"CASE WHEN {hit} + {fpos} > 0 THEN {hit} / ({hit} + {fpos})::DOUBLE ELSE 0 END"
    rec = f"CASE WHEN {hit} + {miss} > 0 THEN {hit} / ({hit} + {miss})::DOUBLE ELSE 0 END"
    f1 = f"CASE WHEN ({prec}) + ({rec}) > 0 THEN 2 * ({prec}) * ({rec}) / (({prec}) + ({rec})) ELSE 0 END"
    return (f"SELECT {label} AS label, round({prec}, 6) AS precision, round({rec}, 6) AS recall, "
            f"round({f1}, 6) AS f1, {hit} + {miss} AS support FROM cm")


@query(
    "ml_class_report",
    S.with_(S.SCORED, _CM) + _report_sql(0, "tn", "fn", "fp") + " UNION ALL " + _report_sql(1, "tp", "fp", "fn"),
)
def q_ml_class_report(spark, sf_dir):
    return _r6_all(M.class_report(scored(spark, sf_dir)), ["precision", "recall", "f1"])


_PTS = """pts AS (SELECT y_prob AS score, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true <> 1) AS neg FROM scored GROUP BY 1),
cum AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS TP,
               sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS FP,
               sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM pts)"""


@query(
    "ml_roc_auc",
    S.with_(S.SCORED, _PTS) + "SELECT round(sum(neg * (TP - pos / 2.0)) / (max(P) * max(N)), 6) AS roc_auc FROM cum",
)
def q_ml_roc_auc(spark, sf_dir):
    return _r6_all(M.roc_auc(M.score_points(scored(spark, sf_dir))), ["roc_auc"])


@query(
    "ml_roc_curve",
    S.with_(S.SCORED, _PTS)
    + """SELECT score AS threshold, round(FP / N::DOUBLE, 6) AS fpr, round(TP / P::DOUBLE, 6) AS tpr FROM cum
UNION ALL SELECT NULL, 0.0, 0.0""",
)
def q_ml_roc_curve(spark, sf_dir):
    return _r6_all(M.roc_curve(M.score_points(scored(spark, sf_dir))), ["fpr", "tpr"])


@query(
    "ml_avg_precision",
    S.with_(S.SCORED, _PTS) + "SELECT round(sum(pos / P::DOUBLE * (TP / (TP + FP)::DOUBLE)), 6) AS average_precision FROM cum",
)
def q_ml_avg_precision(spark, sf_dir):
    return _r6_all(M.average_precision(M.score_points(scored(spark, sf_dir))), ["average_precision"])


@query(
    "ml_pr_curve",
    S.with_(S.SCORED, _PTS)
    + """SELECT score AS threshold, round(TP / (TP + FP)::DOUBLE, 6) AS precision, round(TP / P::DOUBLE, 6) AS recall
FROM cum WHERE TP - pos < P
UNION ALL SELECT NULL, 1.0, 0.0""",
)
def q_ml_pr_curve(spark, sf_dir):
    return _r6_all(M.pr_curve(M.score_points(scored(spark, sf_dir))), ["precision", "recall"])


_THR = "thr(idx, t) AS (VALUES " + ", ".join(f"({i + 1}, '{t!r}'::DOUBLE)" for i, t in enumerate(M.SWEEP)) + ")"
_SWEEP = (
    S.with_(S.SCORED, _THR)
    + """, c AS (SELECT thr.idx, thr.t,
              count(*) FILTER (WHERE y_true = 1 AND y_prob >= t) AS tp, count(*) FILTER (WHERE y_true <> 1 AND y_prob >= t) AS fp,
              count(*) FILTER (WHERE y_true = 1 AND y_prob < t) AS fn, count(*) FILTER (WHERE y_true <> 1 AND y_prob < t) AS tn
       FROM thr, scored GROUP BY 1, 2),
sw AS (SELECT CAST(idx AS INTEGER) AS idx, """
    + S.bround("t", 2)
    + """ AS threshold,
       (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy,
       CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1,
       tp / (tp + fp + 1e-9) AS precision, tp / (tp + fn + 1e-9) AS recall FROM c)
"""
)


@query(
    "ml_threshold_sweep",
    _SWEEP + "SELECT idx, threshold, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, "
    "round(precision, 6) AS precision, round(recall, 6) AS recall FROM sw",
)
def q_ml_threshold_sweep(spark, sf_dir):
    s = M.threshold_sweep(scored(spark, sf_dir)).drop("_thr")
    return _r6_all(s, ["accuracy", "f1", "precision", "recall"])


@query(
    "ml_best_threshold",
    _SWEEP
    + """SELECT CASE WHEN max(f1) > 0 THEN arg_max(threshold, f1 * 1000000 - idx) ELSE 0.5 END AS best_threshold,
       round(max(f1), 6) AS best_f1 FROM sw""",
)
def q_ml_best_threshold(spark, sf_dir):
    b = M.best_threshold(M.threshold_sweep(scored(spark, sf_dir)))
    return _r6_all(b, ["best_f1"])


@query(
    "ml_calibration",
    S.with_(S.SCORED)
    + "SELECT CAST("
    + " + ".join(f"CAST(y_prob > '{e!r}'::DOUBLE AS INTEGER)" for e in M.CAL_EDGES)
    + """ AS INTEGER) AS bin, round(avg(y_prob), 6) AS mean_predicted,
       round(avg(CAST(y_true AS DOUBLE)), 6) AS fraction_positive, count(*) AS n FROM scored GROUP BY 1""",
)
def q_ml_calibration(spark, sf_dir):
    return _r6_all(M.calibration(scored(spark, sf_dir)), ["mean_predicted", "fraction_positive"])


# --- regression metrics ------------------------------------------------------------


def persistence_pairs(clean_df, horizon: int = 5):
    """(location, time, step, y_true = value h rows ahead, y_pred = current value)."""
    d = windows.ensure_index(clean_df.select(KEY, TIME, "temperature"))
    ahead = series.framed(
        d, lambda w: [F.lead("temperature", h).over(w).alias(f"_y{h}") for h in range(1, horizon + 1)], 0, horizon
    )
    long = ahead.select(
        KEY, TIME, F.col("temperature").alias("y_pred"),
        F.inline(F.array(*[F.struct(F.lit(h).alias("step"), F.col(f"_y{h}").alias("y_true")) for h in range(1, horizon + 1)])),
    )
    return long.filter(F.col("y_true").isNotNull())


_PAIRS = (
    CLEAN
    + ", pairs AS (SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT location_id, valid_time, {h} AS step, temperature AS y_pred, "
        f"lead(temperature, {h}) OVER (PARTITION BY location_id ORDER BY valid_time) AS y_true FROM clean"
        for h in range(1, 6)
    )
    + ") WHERE y_true IS NOT NULL),\n"
    + """met AS (
  SELECT '+' || step || 'h' AS step, avg(abs(y_pred - y_true)) AS mae, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse,
         1 - sum((y_pred - y_true) * (y_pred - y_true)) / (var_pop(y_true) * count(y_true)) AS r2, count(*) AS n
  FROM pairs GROUP BY step
  UNION ALL
  SELECT 'overall', avg(abs(y_pred - y_true)), sqrt(avg((y_pred - y_true) * (y_pred - y_true))),
         1 - sum((y_pred - y_true) * (y_pred - y_true)) / (var_pop(y_true) * count(y_true)), count(*) FROM pairs)
"""
)


@query(
    "ml_regression_metrics",
    _PAIRS + "SELECT step, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, n FROM met",
)
def q_ml_regression_metrics(spark, sf_dir):
    m = M.regression_metrics(persistence_pairs(clean(spark, sf_dir)))
    return _r6_all(m, ["mae", "rmse", "r2"])


@query(
    "ml_forecast_band",
    _PAIRS
    + """SELECT p.location_id, p.valid_time, CAST(p.step AS INTEGER) AS step, p.y_pred,
       round(p.y_pred - m.mae, 6) AS lower, round(p.y_pred + m.mae, 6) AS upper
FROM pairs p JOIN met m ON m.step = 'overall'""",
)
def q_ml_forecast_band(spark, sf_dir):
    pairs = persistence_pairs(clean(spark, sf_dir))
    # one number for all steps, as the stored model metadata holds it
    mae = pairs.agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true")))).first()[0] or 0.0
    band = M.forecast_band(pairs, mae)
    return band.select(KEY, TIME, "step", "y_pred", r6(F.col("lower")).alias("lower"), r6(F.col("upper")).alias("upper"))


@query(
    "ml_step_bars",
    _PAIRS
    + """SELECT step, round(mae, 6) AS mae, CAST(floor(mae / (1.2 * max(mae) OVER ()) * 100 + 0.5) AS INTEGER) AS bar_pct
FROM met WHERE step <> 'overall'""",
)
def q_ml_step_bars(spark, sf_dir):
    b = M.step_bars(M.regression_metrics(persistence_pairs(clean(spark, sf_dir))))
    return _r6_all(b, ["mae"])
