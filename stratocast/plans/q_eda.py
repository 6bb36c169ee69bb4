"""Queries: EDA aggregates (AG-*), sorts and top-k (ST-*), union (SO-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import eda
from ..schema import KEY, TIME
from ..sources.tables import STANDIN_RAIN_THRESHOLD, clean_table, load, obs_table, order_months
from . import sqlparts as S
from .catalog import query, r6
from .features import build_features, drop_incomplete

CLEAN_FEAT = S.with_(S.OBS, S.CLEAN, S.feat(STANDIN_RAIN_THRESHOLD, source="clean"))
MEASURES = ["temperature", "surface_pressure", "total_cloud_cover", "low_cloud_cover", "medium_cloud_cover", "high_cloud_cover", "precipitation", "humidity",
            "wind_speed"]


def obs(spark, sf_dir):
    return obs_table(spark, sf_dir)


def clean(spark, sf_dir):
    return clean_table(spark, sf_dir)


def feats(spark, sf_dir):
    return build_features(clean_table(spark, sf_dir, keep_index=True), threshold=STANDIN_RAIN_THRESHOLD)


@query(
    "ag_class_balance",
    CLEAN_FEAT
    + """SELECT count(*) FILTER (WHERE rain_tomorrow = 1) AS n_pos, count(*) FILTER (WHERE rain_tomorrow = 0) AS n_neg,
       count(rain_tomorrow) AS n_valid,
       round(count(*) FILTER (WHERE rain_tomorrow = 1) * 100.0::DOUBLE / count(rain_tomorrow), 6) AS pos_pct,
       round(count(*) FILTER (WHERE rain_tomorrow = 0) / greatest(count(*) FILTER (WHERE rain_tomorrow = 1), 1)::DOUBLE, 6) AS imbalance_ratio
FROM feat""",
)
def q_ag_class_balance(spark, sf_dir):
    b = eda.class_balance(feats(spark, sf_dir))
    return b.select("n_pos", "n_neg", "n_valid", r6(F.col("pos_pct")).alias("pos_pct"),
                    r6(F.col("imbalance_ratio")).alias("imbalance_ratio"))


@query(
    "ag_monthly_rate",
    """SELECT CAST(month(o_orderdate) AS INTEGER) AS month,
       round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) * 100, 6) AS rate_pct, count(*) AS n_rows
FROM orders GROUP BY 1""",
)
def q_ag_monthly_rate(spark, sf_dir):
    r = eda.rate_by(order_months(load(spark, sf_dir, "orders")), ["month"], "label")
    return r.select("month", r6(F.col("rate_pct")).alias("rate_pct"), "n_rows")


_MEANS = ["temperature", "surface_pressure", "total_cloud_cover", "precipitation", "humidity"]


@query(
    "ag_means_by_class",
    CLEAN_FEAT
    + """, kept AS (SELECT * FROM feat WHERE temp_lag_1 IS NOT NULL AND temp_lag_24 IS NOT NULL
                  AND temp_rolling_6 IS NOT NULL)
"""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {S.bround(f'avg({c}) FILTER (WHERE rain_tomorrow = 0)', 2)} AS class_0, "
        f"{S.bround(f'avg({c}) FILTER (WHERE rain_tomorrow = 1)', 2)} AS class_1 FROM kept\n"
        for c in _MEANS
    ),
)
def q_ag_means_by_class(spark, sf_dir):
    return eda.means_by_class(drop_incomplete(feats(spark, sf_dir)), _MEANS)


@query(
    "ag_diurnal",
    S.with_(S.OBS, S.CLEAN)
    + """SELECT CAST(hour(valid_time) AS INTEGER) AS hour, round(avg(temperature), 6) AS mean_temperature,
       count(temperature) AS n FROM clean GROUP BY 1""",
)
def q_ag_diurnal(spark, sf_dir):
    m = eda.mean_by(clean(spark, sf_dir), [F.hour(TIME).alias("hour")], "temperature")
    return m.select("hour", r6(F.col("mean_temperature")).alias("mean_temperature"), "n")


@query(
    "ag_monthly_quartiles",
    """SELECT CAST(month(o_orderdate) AS INTEGER) AS month, count(o_totalprice) AS n,
       min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 6) AS q1,
       round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.75), 6) AS q3,
       max(o_totalprice) AS max
FROM orders GROUP BY 1""",
)
def q_ag_monthly_quartiles(spark, sf_dir):
    f = eda.five_numbers(order_months(load(spark, sf_dir, "orders")), ["month"], "o_totalprice")
    return f.select("month", "n", "min", *[r6(F.col(c)).alias(c) for c in ("q1", "median", "q3")], "max")


@query(
    "ag_describe",
    S.with_(S.OBS, S.CLEAN)
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25,
       round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max
FROM clean
"""
        for c in MEASURES
    ),
)
def q_ag_describe(spark, sf_dir):
    d = eda.describe(clean(spark, sf_dir), MEASURES)
    return d.select("column_name", "count", *[r6(F.col(c)).alias(c) for c in ("mean", "std")], "min",
                    *[r6(F.col(c)).alias(c) for c in ("p25", "p50", "p75")], "max")


_OBS_COLS = ["location_id", "valid_time", "temperature", "precipitation", "humidity", "surface_pressure",
             "wind_speed", "total_cloud_cover", "low_cloud_cover", "medium_cloud_cover", "high_cloud_cover", "n"]


@query(
    "ag_null_counts",
    S.with_(S.OBS)
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM obs\n" for c in _OBS_COLS)
    + " UNION ALL SELECT 'TOTAL', "
    + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in _OBS_COLS)
    + " FROM obs",
)
def q_ag_null_counts(spark, sf_dir):
    return eda.null_counts(obs(spark, sf_dir), _OBS_COLS)


_PROFILE = [
    ("location_id", "bigint"), ("valid_time", "timestamp_ntz"), ("temperature", "double"),
    ("surface_pressure", "double"), ("total_cloud_cover", "double"), ("precipitation", "double"),
    ("humidity", "double"), ("wind_speed", "double"), ("hour", "int"), ("day", "int"), ("month", "int"),
    ("day_of_week", "int"), ("temp_lag_1", "double"), ("temp_lag_24", "double"), ("temp_rolling_6", "double"),
    ("hour_sin", "double"), ("hour_cos", "double"), ("month_sin", "double"), ("month_cos", "double"),
    ("rain_tomorrow", "int"),
]


@query(
    "ag_profile",
    CLEAN_FEAT
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
        + (f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max" if t != "timestamp_ntz"
           else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max")
        + " FROM feat\n"
        for c, t in _PROFILE
    ),
)
def q_ag_profile(spark, sf_dir):
    return eda.profile(feats(spark, sf_dir), [c for c, _ in _PROFILE])


@query(
    "ag_date_range",
    S.with_(S.OBS)
    + "SELECT location_id, min(valid_time) AS first_time, max(valid_time) AS last_time, count(*) AS n_rows "
    "FROM obs GROUP BY 1",
)
def q_ag_date_range(spark, sf_dir):
    return eda.date_range(obs(spark, sf_dir))


_CORR = ["surface_pressure", "total_cloud_cover", "precipitation", "wind_speed", "temp_rolling_6",
         "temp_lag_1", "temp_lag_24", "month"]


@query(
    "ag_corr_target",
    CLEAN_FEAT
    + ", c AS ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CASE WHEN isnan(corr({f}, temperature)) THEN NULL "
        f"ELSE corr({f}, temperature) END AS corr FROM feat\n"
        for f in _CORR
    )
    + """)
SELECT feature, round(corr, 6) AS corr,
       CAST(row_number() OVER (ORDER BY corr ASC NULLS LAST, feature) AS INTEGER) AS rank FROM c""",
)
def q_ag_corr_target(spark, sf_dir):
    c = eda.corr_with(feats(spark, sf_dir), "temperature", _CORR)
    return c.select("feature", r6(F.col("corr")).alias("corr"), "rank")


@query(
    "st_sorted",
    S.with_(S.OBS) + "SELECT location_id, valid_time, temperature FROM obs ORDER BY location_id, valid_time",
)
def q_st_sorted(spark, sf_dir):
    return obs(spark, sf_dir).select(KEY, TIME, "temperature").orderBy(KEY, TIME)


@query(
    "st_topk",
    S.with_(S.OBS)
    + "SELECT location_id, valid_time, temperature FROM obs "
    "ORDER BY temperature DESC, location_id, valid_time LIMIT 10",
)
def q_st_topk(spark, sf_dir):
    o = obs(spark, sf_dir).select(KEY, TIME, "temperature")
    return eda.top_k(o, 10, [F.col("temperature").desc(), F.col(KEY), F.col(TIME)])


@query("so_union_all", "SELECT event_id, event_type, value FROM events")
def q_so_union_all(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select("event_id", "event_type", "value")
    kinds = ["view", "click", "purchase", "signup", "error"]
    parts = [ev.filter(F.col("event_type") == k) for k in kinds]
    parts.append(ev.filter(~F.col("event_type").isin(kinds) | F.col("event_type").isNull()))
    return eda.union_all(parts)
