"""Exploratory aggregates: class balance, group means, profiles, quantiles, correlations.

Every operator is one grouped aggregate (partial + final), optionally
unpivoted into long form; nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY, TIME

QUARTILES = [0.25, 0.5, 0.75]


def class_balance(df: DataFrame, label: str = "rain_tomorrow", by: Sequence[str] = ()) -> DataFrame:
    """Counts of 1 and 0, percent of 1, and the 0:1 ratio (denominator >= 1)."""
    pos = F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) == 0)
    valid = F.count(F.col(label))
    out = df.groupBy(*by).agg(pos.alias("n_pos"), neg.alias("n_neg"), valid.alias("n_valid"))
    return out.withColumns(
        {
            "pos_pct": F.when(F.col("n_valid") > 0, F.col("n_pos") * 100.0 / F.col("n_valid")).otherwise(0.0),
            "imbalance_ratio": F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1)),
        }
    )


def rate_by(df: DataFrame, group: Sequence[str], label: str, scale: float = 100.0) -> DataFrame:
    """Mean of a 0/1 label per group, times ``scale``."""
    return df.groupBy(*group).agg(
        (F.avg(F.col(label)) * scale).alias("rate_pct"), F.count(F.lit(1)).alias("n_rows")
    )


def means_by_class(df: DataFrame, features: Sequence[str], label: str = "rain_tomorrow", digits: int = 2) -> DataFrame:
    """Feature means per class, transposed: one row per feature, one column per class."""
    long = df.select(F.col(label), F.explode(F.map_from_arrays(
        F.array(*[F.lit(f) for f in features]), F.array(*[F.col(f).cast("double") for f in features])
    )).alias("feature", "value"))
    wide = long.groupBy("feature").pivot(label, [0, 1]).agg(F.avg("value"))
    return wide.select(
        "feature",
        F.bround(F.col("0"), digits).alias("class_0"),
        F.bround(F.col("1"), digits).alias("class_1"),
    )


def mean_by(df: DataFrame, group: Sequence, col: str) -> DataFrame:
    return df.groupBy(*group).agg(F.avg(F.col(col)).alias(f"mean_{col}"), F.count(F.col(col)).alias("n"))


def five_numbers(df: DataFrame, group: Sequence[str], col: str, exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """min, quartiles (linear interpolation), max per group.

    ``exact`` finds the order statistics by narrowing value intervals
    (``quantiles.exact_quantiles``), so no task holds a group's values;
    ``exact=False`` uses ``percentile_approx`` with bounded state.
    """
    c = F.col(col)
    names = ["q1", "median", "q3"]
    out = df.groupBy(*group).agg(F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("n"))
    if exact:
        from .quantiles import quantile_columns

        q = quantile_columns(df, group, col, QUARTILES, names)
        out = out.join(q, list(group), "left")
        return out.select(*group, "n", "min", *names, "max")
    approx = F.percentile_approx(c, F.array(*[F.lit(x) for x in QUARTILES]), accuracy)
    out = df.groupBy(*group).agg(F.min(c).alias("min"), approx.alias("_q"), F.max(c).alias("max"), F.count(c).alias("n"))
    return out.select(*group, "n", "min", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)], "max")


def describe(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """count, mean, sample std, min, quartiles, max for each column (long form)."""
    long = df.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(c) for c in cols]), F.array(*[F.col(c).cast("double") for c in cols])
    )).alias("column_name", "value"))
    v = F.col("value")
    stats = [
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    ]
    names = ["p25", "p50", "p75"]
    if exact:
        from .quantiles import quantile_columns

        out = long.groupBy("column_name").agg(*stats)
        out = out.join(quantile_columns(long, ["column_name"], "value", QUARTILES, names), "column_name", "left")
    else:
        approx = F.percentile_approx(v, F.array(*[F.lit(x) for x in QUARTILES]), 10000)
        out = long.groupBy("column_name").agg(*stats, approx.alias("_q"))
        out = out.select("*", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    return out.select("column_name", "count", "mean", "std", "min", *names, "max")


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column and their total, in one aggregate pass (long form)."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column_name", "nulls")
    total = wide.select(F.lit("TOTAL").alias("column_name"), sum((F.col(c) for c in cols), F.lit(0)).alias("nulls"))
    return long.unionByName(total)


def profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Type, null count, min and max of each column (numeric min/max as double)."""
    cols = list(cols or df.columns)
    types = dict(df.dtypes)
    numeric = {c for c in cols if types[c] in ("double", "float", "int", "bigint", "smallint", "tinyint")}
    aggs = []
    for c in cols:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"))
        if c in numeric:
            aggs += [F.min(F.col(c)).cast("double").alias(f"{c}__min"), F.max(F.col(c)).cast("double").alias(f"{c}__max")]
    wide = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(types[c]).alias("dtype"),
            F.col(f"{c}__nulls").alias("nulls"),
            (F.col(f"{c}__min") if c in numeric else F.lit(None).cast("double")).alias("min"),
            (F.col(f"{c}__max") if c in numeric else F.lit(None).cast("double")).alias("max"),
        )
        for c in cols
    ]
    return wide.select(F.inline(F.array(*rows)))


def date_range(df: DataFrame, by: Sequence[str] = (KEY,)) -> DataFrame:
    return df.groupBy(*by).agg(
        F.min(TIME).alias("first_time"), F.max(TIME).alias("last_time"), F.count(F.lit(1)).alias("n_rows")
    )


def safe_corr(x, y):
    """Pearson correlation over pairwise non-null rows; null (not an ANSI
    divide-by-zero error) when either side is constant."""
    xm = F.when(y.isNotNull(), x)
    ym = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(xm) * F.stddev_samp(ym))


def corr_with(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Pearson correlation of each feature with ``target`` (pairwise non-null),
    ascending, with its rank; NaN (constant input) reported as null."""
    wide = df.agg(*[safe_corr(F.col(f).cast("double"), F.col(target)).alias(f) for f in features])
    long = wide.unpivot([], list(features), "feature", "corr").withColumn(
        "corr", F.nanvl(F.col("corr"), F.lit(None).cast("double"))
    )
    w = Window.orderBy(F.col("corr").asc_nulls_last(), F.col("feature"))
    # ``long`` has one row per feature: the global window sorts len(features) rows
    return long.withColumn("rank", F.row_number().over(w))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Vertical concatenation by column name, duplicates kept."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def top_k(df: DataFrame, k: int, order: Sequence) -> DataFrame:
    """The first ``k`` rows in ``order`` (plans as TakeOrdered: per-partition top-k, then merge)."""
    return df.orderBy(*order).limit(k)
