"""Queries: streaming ingest, live features and scoring (STR-1..3).

The driver's ``events`` table is replayed as a file stream: it is appended to a
fresh shared folder in a few time slices, and after each slice the query is
restarted from its checkpoint with ``availableNow``, so it consumes the new
files as one micro-batch and stops.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..schema import KEY, TIME
from ..session import shared_path
from ..sources.tables import STANDIN_RAIN_THRESHOLD, load, obs_hourly
from ..streaming import ingest, state, store
from . import sqlparts as S
from .catalog import query, r6
from .clean import clean_series
from .features import build_features

N_SLICES = 4


def replay(spark, sf_dir, run_once, n_slices: int = N_SLICES):
    """Replay ``events`` as a file stream that arrives in ``n_slices`` time slices.

    Each slice is appended to a fresh shared folder by an ordinary parallel write
    (one file per task), then ``run_once()`` starts the streaming query with
    ``availableNow`` from its checkpoint: it consumes exactly the files that are
    new since the last run, as one micro-batch, and stops.  Restarting from the
    checkpoint is the same path a query takes after a driver failure, and every
    row of a slice is later than every row of the slices before it, so no row is
    behind the watermark.  Returns the source folder and its schema.
    """
    ev = load(spark, sf_dir, "events")
    src = shared_path(spark, "events_stream")
    bounds = ev.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    lo, hi = bounds["lo"], bounds["hi"]
    if lo is None:
        return src, ev.schema
    step = (hi - lo) / n_slices
    # slice boundaries as TIMESTAMP_NTZ literals parsed from text (no zone involved);
    # the first slice has no lower bound and the last no upper bound, so every row lands once
    cuts = [F.to_timestamp_ntz(F.lit((lo + step * i).isoformat())) for i in range(1, n_slices)]
    for i in range(n_slices):
        cond = F.lit(True)
        if i > 0:
            cond = cond & (F.col("ts") >= cuts[i - 1])
        if i < n_slices - 1:
            cond = cond & (F.col("ts") < cuts[i])
        ev.filter(cond).write.mode("append").parquet(src)
        run_once(src, ev.schema)
    return src, ev.schema


_VALUES = ["temperature", "precipitation", "humidity", "surface_pressure", "wind_speed", "total_cloud_cover",
           "low_cloud_cover", "medium_cloud_cover", "high_cloud_cover"]


@query(
    "str_ingest",
    S.with_(S.OBS)
    + "SELECT location_id, valid_time, "
    + ", ".join(f"{S.hround(c, 6)} AS {c}" for c in _VALUES)
    + ", n FROM obs",
)
def q_str_ingest(spark, sf_dir):
    root = shared_path(spark, "obs_store")
    ckpt = shared_path(spark, "ckpt_ingest")

    def run_once(src, schema):
        ingest.run_ingest(spark, src, store.log_of(root), ckpt, schema, skip_empty_batches=True)
        store.compact(spark, root, [KEY, TIME])
        store.vacuum(spark, root)

    replay(spark, sf_dir, run_once)
    out = store.read_latest(spark, root, [KEY, TIME])
    if out is None:  # no events
        out = obs_hourly(load(spark, sf_dir, "events"))
    return out.select(KEY, TIME, *[r6(F.col(c)).alias(c) for c in _VALUES], "n")


@query(
    "str_features",
    S.with_(S.OBS)
    + """, t AS (SELECT *, count(*) OVER (PARTITION BY location_id) AS n_rows,
                  row_number() OVER (PARTITION BY location_id ORDER BY valid_time DESC) - 1 AS b FROM obs),
a AS (SELECT location_id, max(n_rows) AS n_rows,
             max(CASE WHEN b = 0 THEN valid_time END) AS valid_time,
             max(CASE WHEN b = 0 THEN temperature END) AS temp_now,
             max(CASE WHEN b = 1 THEN temperature END) AS v1,
             max(CASE WHEN b = 24 THEN temperature END) AS v24,
             avg(CASE WHEN b BETWEEN 1 AND 6 THEN temperature END) AS m6
      FROM t GROUP BY 1)
SELECT location_id, valid_time, n_rows, round(temp_now, 6) AS temp_now, round(v1, 6) AS temp_lag_1,
       round(v24, 6) AS temp_lag_24, """
    + S.bround("m6", 4)
    + " AS temp_rolling_6 FROM a",
)
def q_str_features(spark, sf_dir):
    out_dir = follow(spark, sf_dir, "live_features", ["temperature"], lambda out: state.feature_writer(out))
    f = ingest.latest(spark, out_dir, [KEY])
    return f.select(
        KEY, TIME, "n_rows", r6(F.col("temp_now")).alias("temp_now"), r6(F.col("temp_lag_1")).alias("temp_lag_1"),
        r6(F.col("temp_lag_24")).alias("temp_lag_24"), "temp_rolling_6",
    )


def follow(spark, sf_dir, name, values, writer):
    """Replay the events through the ingest and, after each slice, a query that follows its log into ``writer(folder)``."""
    root, out_dir = shared_path(spark, "obs_store"), shared_path(spark, name)
    first, second = shared_path(spark, "ckpt_ingest"), shared_path(spark, f"ckpt_{name}")
    obs = obs_hourly(load(spark, sf_dir, "events")).schema

    def run_once(src, schema):
        ingest.run_ingest(spark, src, store.log_of(root), first, schema, skip_empty_batches=True)
        state.follow_store(spark, store.log_of(root), obs, second, writer(out_dir), values)

    replay(spark, sf_dir, run_once)
    return out_dir


@query("str_scoring")
def q_str_scoring(spark, sf_dir):
    """Load the rain classifier fitted on the batch history, and score every arriving
    hour with features built from the rows kept in state for its location."""
    from ..operators import models
    from .q_models import rain_model

    model, threshold, _ = rain_model(spark, sf_dir)
    present = model.features

    def score(rows):
        # cleaned as the training rows were; rows without 24 rows of history or
        # with an unknown value are not scored
        feats = build_features(clean_series(rows), threshold=STANDIN_RAIN_THRESHOLD).na.drop(subset=present)
        return models.rain_predictions(model.score(feats).select(KEY, TIME, "y_prob"), threshold)

    out_dir = follow(spark, sf_dir, "rain_scores", _VALUES, lambda out: state.scoring_writer(score, out))
    return ingest.latest(spark, out_dir, [KEY, TIME])
