"""Shared pieces of the DuckDB reference SQL (the correctness oracle).

These strings restate each query in plain SQL over the driver tables so the
driver can compare results; they are not used by the Spark side.
"""

from __future__ import annotations

from ..schema import CLEAN_COLUMNS, VALID_RANGES


def bround(expr: str, digits: int) -> str:
    """Half-even rounding of the shortest decimal form of a double (= Spark bround)."""
    return f"CAST(round_even(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,28)), {digits}) AS DOUBLE)"


def hround(expr: str, digits: int) -> str:
    """Half-up rounding of the shortest decimal form of a double (= Spark round)."""
    return f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,28)), {digits}) AS DOUBLE)"


OBS = """obs AS (
  SELECT user_id // 10 AS location_id,
         date_trunc('hour', ts) AS valid_time,
         avg(value) / 5 AS temperature,
         avg(CASE WHEN event_type = 'purchase' THEN value ELSE 0.0::DOUBLE END) / 5 AS precipitation,
         avg(value) FILTER (WHERE event_type = 'view') AS humidity,
         1000.0::DOUBLE + avg(value) / 10 AS surface_pressure,
         max(value) / 10 AS wind_speed,
         avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS total_cloud_cover,
         avg(value) / 300 AS low_cloud_cover,
         max(value) / 1000 AS medium_cloud_cover,
         avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / 2 AS high_cloud_cover,
         count(*) AS n
  FROM events
  GROUP BY 1, 2)"""


def feat(threshold: float = 48.0, lookahead: int = 24, source: str = "obs") -> str:
    """Feature CTE over ``source`` (lags, rolling mean, label, date parts, cyclic)."""
    roll = bround("avg(temperature) OVER w6", 4)
    return f"""feat AS (
  SELECT b.*,
         CAST(hour(valid_time) AS INTEGER) AS hour,
         CAST(day(valid_time) AS INTEGER) AS day,
         CAST(month(valid_time) AS INTEGER) AS month,
         CAST(isodow(valid_time) - 1 AS INTEGER) AS day_of_week,
         {bround("sin(2 * pi() * hour(valid_time) / 24)", 6)} AS hour_sin,
         {bround("cos(2 * pi() * hour(valid_time) / 24)", 6)} AS hour_cos,
         {bround("sin(2 * pi() * month(valid_time) / 12)", 6)} AS month_sin,
         {bround("cos(2 * pi() * month(valid_time) / 12)", 6)} AS month_cos
  FROM (
    SELECT s.*,
           lag(temperature, 1) OVER w AS temp_lag_1,
           lag(temperature, 24) OVER w AS temp_lag_24,
           CASE WHEN count(temperature) OVER w6 = 6 THEN {roll} END AS temp_rolling_6,
           CAST(coalesce(CASE WHEN count(precipitation) OVER wf = {lookahead}
                              THEN sum(precipitation) OVER wf > {threshold} END, false) AS INTEGER)
             AS rain_tomorrow
    FROM {source} s
    WINDOW w AS (PARTITION BY location_id ORDER BY valid_time),
           w6 AS (PARTITION BY location_id ORDER BY valid_time ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
           wf AS (PARTITION BY location_id ORDER BY valid_time
                  ROWS BETWEEN 1 FOLLOWING AND {lookahead} FOLLOWING)
  ) b)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


RAW = """raw AS (
  SELECT event_id,
         ts AS valid_time,
         26.0::DOUBLE + 0.25 * (user_id % 4) AS latitude,
         83.0::DOUBLE + 0.25 * (user_id % 3) AS longitude,
         273.15::DOUBLE + value / 10 AS t2m,
         273.15::DOUBLE + value / 20 AS d2m,
         100000.0::DOUBLE + value AS sp,
         (value - 10) / 1000 AS tp,
         value / 50 AS u10,
         user_id / 10.0::DOUBLE AS v10,
         value / 200 AS tcc,
         value / 400 AS lcc,
         value / 800 AS mcc,
         CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hcc
  FROM events)"""

DAILY = """daily AS (
  SELECT user_id // 10 AS location_id,
         CAST(ts AS DATE) AS day,
         min(value) / 5 AS temperature_2m_min,
         max(value) / 5 AS temperature_2m_max,
         max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS weathercode,
         max(value) / 10 AS windspeed_10m_max
  FROM events
  GROUP BY 1, 2)"""

SCORED = """scored AS (
  SELECT doc_id, quality AS y_true, toxic AS y_true_2,
         ((doc_id * 7919) % 1000) / 1000.0::DOUBLE AS y_prob
  FROM labels)"""


def interp(cols, source: str = "obs", name: str = "interp", mode: str = "linear") -> str:
    """Per-location linear interpolation by row (edges nearest) or ffill/bfill."""
    nb = []
    for c in cols:
        nb.append(
            f"last_value(CASE WHEN {c} IS NOT NULL THEN _rn END IGNORE NULLS) OVER wp AS {c}__prn, "
            f"last_value({c} IGNORE NULLS) OVER wp AS {c}__pv, "
            f"first_value(CASE WHEN {c} IS NOT NULL THEN _rn END IGNORE NULLS) OVER wn AS {c}__nrn, "
            f"first_value({c} IGNORE NULLS) OVER wn AS {c}__nv"
        )
    outs = []
    for c in cols:
        if mode == "linear":
            outs.append(
                f"CASE WHEN {c} IS NOT NULL THEN {c} "
                f"WHEN {c}__pv IS NOT NULL AND {c}__nv IS NOT NULL THEN "
                f"({c}__nv - {c}__pv) / CAST({c}__nrn - {c}__prn AS DOUBLE) * CAST(_rn - {c}__prn AS DOUBLE) + {c}__pv "
                f"ELSE coalesce({c}__pv, {c}__nv) END AS {c}"
            )
        else:
            outs.append(f"coalesce({c}, {c}__pv, {c}__nv) AS {c}")
    return f"""{name} AS (
  SELECT * EXCLUDE ({', '.join(f'{c}__prn, {c}__pv, {c}__nrn, {c}__nv' for c in cols)}) REPLACE ({', '.join(outs)})
  FROM (
    SELECT *, {', '.join(nb)}
    FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY valid_time) AS _rn FROM {source}) i
    WINDOW wp AS (PARTITION BY location_id ORDER BY _rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           wn AS (PARTITION BY location_id ORDER BY _rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
  ) x)"""


BOUNDS = VALID_RANGES


def clip_expr(c: str) -> str:
    lo, hi = BOUNDS[c]
    return f"CASE WHEN {c} < {lo} THEN {lo}::DOUBLE WHEN {c} > {hi} THEN {hi}::DOUBLE ELSE {c} END"


OBS_MEASURES = CLEAN_COLUMNS[1:]

# obs -> interpolated -> clipped -> final columns (location first)
CLEAN = (
    interp(OBS_MEASURES, "obs", "interp")
    + """,
clean AS (
  SELECT location_id, valid_time, """
    + ", ".join(f"{clip_expr(c)} AS {c}" for c in OBS_MEASURES)
    + """
  FROM interp)"""
)
