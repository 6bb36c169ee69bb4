"""Queries: feature windows (WN-*), labels and the flagship rain-rate report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows
from ..schema import KEY, TIME
from ..sources.tables import STANDIN_RAIN_THRESHOLD, clean_table, load, obs_table
from . import sqlparts as S
from .catalog import query, r6
from .features import build_features, rain_rate_by_month_hour


def obs(spark, sf_dir):
    return obs_table(spark, sf_dir)


def features(spark, sf_dir, **kw):
    kw.setdefault("threshold", STANDIN_RAIN_THRESHOLD)
    return build_features(obs(spark, sf_dir), **kw)


OBS_FEAT = S.with_(S.OBS, S.feat(STANDIN_RAIN_THRESHOLD))


@query(
    "rain_rate_by_month_hour",
    OBS_FEAT
    + """SELECT CAST(month AS INTEGER) AS month, CAST(hour AS INTEGER) AS hour,
       round(avg(rain_tomorrow) * 100, 6) AS rain_rate_pct, count(*) AS n_hours
FROM feat GROUP BY 1, 2""",
)
def q_rain_rate(spark, sf_dir):
    r = rain_rate_by_month_hour(features(spark, sf_dir))
    return r.select("month", "hour", r6(F.col("rain_rate_pct")).alias("rain_rate_pct"), "n_hours")


@query(
    "wn_lags",
    OBS_FEAT + "SELECT location_id, valid_time, temperature, temp_lag_1, temp_lag_24 FROM feat",
)
def q_wn_lags(spark, sf_dir):
    return windows.add_lag_features(obs(spark, sf_dir)).select(
        KEY, TIME, "temperature", "temp_lag_1", "temp_lag_24"
    )


@query(
    "wn_rolling_mean",
    OBS_FEAT + "SELECT location_id, valid_time, temp_rolling_6 FROM feat",
)
def q_wn_rolling(spark, sf_dir):
    return windows.add_rolling_mean(obs(spark, sf_dir)).select(KEY, TIME, "temp_rolling_6")


@query(
    "wn_label_next24",
    OBS_FEAT + "SELECT location_id, valid_time, rain_tomorrow FROM feat",
)
def q_wn_label(spark, sf_dir):
    return windows.add_rain_label(obs(spark, sf_dir), threshold=STANDIN_RAIN_THRESHOLD).select(
        KEY, TIME, "rain_tomorrow"
    )


# --- more window operators -------------------------------------------------

from ..functions.timeparts import cyclic_features, date_parts  # noqa: E402
from ..operators.series import RN  # noqa: E402
from ..schema import FORECAST_FEATURES  # noqa: E402
from .features import drop_incomplete  # noqa: E402

CLEAN_FEAT = S.with_(S.OBS, S.CLEAN, S.feat(STANDIN_RAIN_THRESHOLD, source="clean"))
W = "WINDOW w AS (PARTITION BY location_id ORDER BY valid_time)"


@query(
    "wn_label_point24",
    S.with_(S.OBS)
    + f"""SELECT location_id, valid_time,
       CAST(coalesce(lead(precipitation, 24) OVER w > 0, false) AS INTEGER) AS rain_point_24
FROM obs {W}""",
)
def q_wn_point24(spark, sf_dir):
    return windows.add_point_label(obs(spark, sf_dir)).select(KEY, TIME, "rain_point_24")


@query(
    "wn_time_diff",
    S.with_(S.OBS)
    + f"""SELECT location_id, valid_time,
       date_diff('second', lag(valid_time) OVER w, valid_time) / 3600.0::DOUBLE AS time_diff_hours
FROM obs {W}""",
)
def q_wn_time_diff(spark, sf_dir):
    return windows.add_time_diff(obs(spark, sf_dir)).select(KEY, TIME, "time_diff_hours")


@query(
    "wn_autocorr",
    S.with_(S.OBS)
    + """, idx AS (SELECT location_id, temperature,
                  row_number() OVER (PARTITION BY location_id ORDER BY valid_time) AS rn FROM obs)
SELECT a.location_id, CAST(l.lag AS INTEGER) AS lag, round(corr(a.temperature, b.temperature), 6) AS autocorr
FROM idx a JOIN range(1, 49) AS l(lag) ON true
LEFT JOIN idx b ON b.location_id = a.location_id AND b.rn = a.rn - l.lag
GROUP BY 1, 2""",
)
def q_wn_autocorr(spark, sf_dir):
    a = windows.autocorrelation(obs(spark, sf_dir), "temperature", 48)
    return a.select(KEY, "lag", r6(F.col("autocorr")).alias("autocorr"))


@query(
    "wn_interpolate",
    S.with_(S.OBS, S.interp(["humidity"], "obs", "interp"))
    + "SELECT location_id, valid_time, humidity FROM interp",
)
def q_wn_interpolate(spark, sf_dir):
    return windows.interpolate_linear(obs(spark, sf_dir), ["humidity"]).select(KEY, TIME, "humidity")


@query(
    "wn_fill",
    S.with_(S.OBS, S.interp(["humidity"], "obs", "filled", mode="fill"))
    + "SELECT location_id, valid_time, humidity FROM filled",
)
def q_wn_fill(spark, sf_dir):
    return windows.fill_forward_backward(obs(spark, sf_dir), ["humidity"]).select(KEY, TIME, "humidity")


@query(
    "wn_dedup_first",
    """SELECT user_id, hour, ts, event_id, event_type, value FROM (
  SELECT user_id, date_trunc('hour', ts) AS hour, ts, event_id, event_type, value,
         row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS rk
  FROM events) WHERE rk = 1""",
)
def q_wn_dedup(spark, sf_dir):
    from ..functions.timeparts import trunc_hour

    ev = load(spark, sf_dir, "events").select(
        "user_id", trunc_hour(F.col("ts")).alias("hour"), "ts", "event_id", "event_type", "value"
    )
    return windows.dedup_first(ev, ["user_id", "hour"], ["ts", "event_id"])


_SEQ_X = " + ".join(f"sum({c}) OVER wx" for c in FORECAST_FEATURES)


@query(
    "wn_sequences",
    CLEAN_FEAT
    + f""", kept AS (SELECT * FROM feat WHERE temp_lag_1 IS NOT NULL AND temp_lag_24 IS NOT NULL
                   AND temp_rolling_6 IS NOT NULL),
s AS (SELECT location_id, valid_time,
             count(*) OVER wx AS nx, count(*) OVER wy AS ny,
             {_SEQ_X} AS sx, sum(temperature) OVER wy AS sy
      FROM kept
      WINDOW wx AS (PARTITION BY location_id ORDER BY valid_time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW),
             wy AS (PARTITION BY location_id ORDER BY valid_time ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
SELECT location_id, count(*) AS n_samples, min(valid_time) AS first_anchor, max(valid_time) AS last_anchor,
       round(sum(sx), 4) AS sum_x, round(sum(sy), 4) AS sum_y
FROM s WHERE nx = 24 AND ny = 5 GROUP BY 1""",
)
def q_wn_sequences(spark, sf_dir):
    f = drop_incomplete(build_features(clean_table(spark, sf_dir, keep_index=True), threshold=STANDIN_RAIN_THRESHOLD))
    seq = windows.sequences(f, FORECAST_FEATURES, 24, 5)
    add = lambda acc, v: acc + v
    per = seq.select(
        KEY,
        TIME,
        F.aggregate(F.flatten("x"), F.lit(0.0), add).alias("sx"),
        F.aggregate("y", F.lit(0.0), add).alias("sy"),
    )
    return per.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.min(TIME).alias("first_anchor"),
        F.max(TIME).alias("last_anchor"),
        F.round(F.sum("sx"), 4).alias("sum_x"),
        F.round(F.sum("sy"), 4).alias("sum_y"),
    )


@query(
    "wn_time_features",
    S.with_(S.OBS)
    + f"""SELECT location_id, valid_time,
       max(temperature) OVER (w RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS temp_lag_1h,
       max(temperature) OVER (w RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND INTERVAL 24 HOURS PRECEDING) AS temp_lag_24h,
       CASE WHEN count(temperature) OVER w6 = 6 THEN {S.bround("avg(temperature) OVER w6", 4)} END AS temp_rolling_6h,
       CAST(coalesce(CASE WHEN count(precipitation) OVER wf = 24 THEN sum(precipitation) OVER wf > 48.0 END, false) AS INTEGER) AS rain_tomorrow
FROM obs
WINDOW w AS (PARTITION BY location_id ORDER BY valid_time),
       w6 AS (PARTITION BY location_id ORDER BY valid_time RANGE BETWEEN INTERVAL 5 HOURS PRECEDING AND CURRENT ROW),
       wf AS (PARTITION BY location_id ORDER BY valid_time RANGE BETWEEN INTERVAL 1 HOUR FOLLOWING AND INTERVAL 24 HOURS FOLLOWING)""",
)
def q_wn_time_features(spark, sf_dir):
    """Features by time on a series with gaps (not filled in)."""
    out = windows.add_time_features(obs_table(spark, sf_dir), threshold=STANDIN_RAIN_THRESHOLD)
    return out.select(KEY, TIME, "temp_lag_1h", "temp_lag_24h", "temp_rolling_6h", "rain_tomorrow")


@query(
    "wn_latest_features",
    S.with_(S.OBS, S.CLEAN)
    + """, t AS (SELECT *, count(*) OVER (PARTITION BY location_id) AS n_rows,
                  row_number() OVER (PARTITION BY location_id ORDER BY valid_time DESC) - 1 AS b FROM clean),
a AS (SELECT location_id, max(n_rows) AS n_rows,
             max(CASE WHEN b = 0 THEN valid_time END) AS valid_time,
             max(CASE WHEN b = 0 THEN temperature END) AS temp_now,
             max(CASE WHEN b = 1 THEN temperature END) AS v1,
             max(CASE WHEN b = 24 THEN temperature END) AS v24,
             avg(CASE WHEN b BETWEEN 1 AND 6 THEN temperature END) AS m6,
             avg(CASE WHEN b >= 1 THEN temperature END) AS mall
      FROM t GROUP BY 1)
SELECT location_id, valid_time, n_rows, temp_now,
       CASE WHEN n_rows >= 2 THEN v1 ELSE temp_now END AS temp_lag_1,
       CASE WHEN n_rows >= 25 THEN v24 ELSE temp_now END AS temp_lag_24,
       CASE WHEN n_rows >= 7 THEN """
    + S.bround("m6", 4)
    + " WHEN n_rows > 1 THEN "
    + S.bround("mall", 4)
    + """ ELSE temp_now END AS temp_rolling_6
FROM a""",
)
def q_wn_latest(spark, sf_dir):
    return windows.latest_features(clean_table(spark, sf_dir))


@query(
    "wn_last_n",
    S.with_(S.OBS, S.CLEAN)
    + f""", f AS (SELECT location_id, valid_time, temperature, humidity,
             lag(temperature, 1) OVER w AS temp_lag_1, lag(temperature, 24) OVER w AS temp_lag_24,
             CASE WHEN count(temperature) OVER w6 = 6 THEN avg(temperature) OVER w6 END AS temp_rolling_6
      FROM clean
      WINDOW w AS (PARTITION BY location_id ORDER BY valid_time),
             w6 AS (PARTITION BY location_id ORDER BY valid_time ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
k AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY valid_time DESC) AS rk FROM f
      WHERE temp_lag_1 IS NOT NULL AND temp_lag_24 IS NOT NULL AND temp_rolling_6 IS NOT NULL)
SELECT location_id, valid_time, temperature, humidity, temp_lag_1, temp_lag_24,
       round(temp_rolling_6, 6) AS temp_rolling_6,
       {S.bround("sin(2 * pi() * hour(valid_time) / 24)", 6)} AS hour_sin,
       {S.bround("cos(2 * pi() * hour(valid_time) / 24)", 6)} AS hour_cos,
       {S.bround("sin(2 * pi() * month(valid_time) / 12)", 6)} AS month_sin,
       {S.bround("cos(2 * pi() * month(valid_time) / 12)", 6)} AS month_cos
FROM k WHERE rk <= 24""",
)
def q_wn_last_n(spark, sf_dir):
    c = clean_table(spark, sf_dir, keep_index=True).select(KEY, TIME, "temperature", "humidity", RN)
    d = windows.ensure_index(c)

    def build(w):
        return [*windows.lag_exprs(w), windows.rolling_mean_expr(w, digits=None)]

    from ..operators import series as _series

    f = _series.framed(d, build, 24, 0)
    f = f.select("*", *date_parts(F.col(TIME))).select("*", *cyclic_features(F.col("hour"), F.col("month")))
    f = f.na.drop(subset=["temp_lag_1", "temp_lag_24", "temp_rolling_6"])
    last = windows.last_n_rows(f, 24)
    return last.select(
        KEY, TIME, "temperature", "humidity", "temp_lag_1", "temp_lag_24",
        r6(F.col("temp_rolling_6")).alias("temp_rolling_6"),
        "hour_sin", "hour_cos", "month_sin", "month_cos",
    )


@query(
    "sc_date_parts",
    S.with_(S.OBS)
    + """SELECT location_id, valid_time, CAST(hour(valid_time) AS INTEGER) AS hour,
       CAST(day(valid_time) AS INTEGER) AS day, CAST(month(valid_time) AS INTEGER) AS month,
       CAST(isodow(valid_time) - 1 AS INTEGER) AS day_of_week FROM obs""",
)
def q_sc_date_parts(spark, sf_dir):
    return obs(spark, sf_dir).select(KEY, TIME, *date_parts(F.col(TIME)))


@query(
    "sc_cyclic",
    OBS_FEAT + "SELECT location_id, valid_time, hour_sin, hour_cos, month_sin, month_cos FROM feat",
)
def q_sc_cyclic(spark, sf_dir):
    o = obs(spark, sf_dir)
    return o.select(KEY, TIME, *cyclic_features(F.hour(TIME), F.month(TIME)))
