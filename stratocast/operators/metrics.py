"""Classification and regression metrics as distributed aggregates.

Curve metrics (ROC-AUC, average precision, the curves themselves) need, for
every distinct score, the cumulative positives and negatives at or above it.
That is a prefix sum in score order; instead of one global sort in one task we
(1) count per distinct score (partial aggregation), (2) cut the distinct
scores into ``buckets`` bins at approximate quantiles and prefix-sum the small
bin table, and (3) run the cumulative window only inside each bin.  Quantile
edges give every bin about the same number of distinct scores however the
scores are distributed (probabilities often crowd near 0), so no bin is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import DEFAULT_THRESHOLD, SWEEP_COUNT, SWEEP_START, SWEEP_STEP
from ..sources.literals import literal_table

# Threshold grid identical to numpy.arange(0.10, 0.91, 0.05): start + i * delta,
# delta taken as (start + step) - start.
_DELTA = (SWEEP_START + SWEEP_STEP) - SWEEP_START
SWEEP = [SWEEP_START + i * _DELTA for i in range(SWEEP_COUNT)]
# Inner edges of 10 uniform calibration bins, as numpy.linspace(0, 1, 11)[1:-1].
CAL_EDGES = [j * 0.1 for j in range(1, 10)]


def _counts(df: DataFrame, y: str, p: str, y_pred: Column) -> DataFrame:
    t = F.col(y) == 1
    return df.agg(
        F.count_if(t & y_pred).alias("tp"),
        F.count_if(~t & y_pred).alias("fp"),
        F.count_if(t & ~y_pred).alias("fn"),
        F.count_if(~t & ~y_pred).alias("tn"),
    )


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b == 0 (zero_division=0)."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, y="y_true", p="y_prob", threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """2x2 counts, accuracy and F1 at ``threshold`` (prediction: p >= threshold)."""
    c = _counts(df, y, p, F.col(p) >= F.lit(threshold))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return c.select(
        "tn", "fp", "fn", "tp",
        _ratio((tp + tn).cast("double"), n).alias("accuracy"),
        _ratio((2 * tp).cast("double"), 2 * tp + fp + fn).alias("f1"),
    )


def class_report(df: DataFrame, y="y_true", p="y_prob", threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Per class: precision, recall, F1, support (zero_division = 0)."""
    c = _counts(df, y, p, F.col(p) >= F.lit(threshold))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))

    def row(cls, hit, false_pos, miss):
        prec = _ratio(hit.cast("double"), hit + false_pos)
        rec = _ratio(hit.cast("double"), hit + miss)
        return F.struct(
            F.lit(cls).alias("label"),
            prec.alias("precision"),
            rec.alias("recall"),
            _ratio(2 * prec * rec, prec + rec).alias("f1"),
            (hit + miss).alias("support"),
        )

    return c.select(F.inline(F.array(row(0, tn, fn, fp), row(1, tp, fp, fn))))


def score_points(df: DataFrame, y="y_true", p="y_prob", buckets: int = 1024) -> DataFrame:
    """One row per distinct (non-null) score with its positives/negatives
    (pos, neg) and the cumulative counts at or above it (TP, FP), plus totals
    P and N."""
    from pyspark.ml.feature import Bucketizer

    t = F.col(y) == 1
    pts = (
        df.filter(F.col(p).isNotNull())
        .groupBy(F.col(p).cast("double").alias("score"))
        .agg(F.count_if(t).alias("pos"), F.count_if(~t).alias("neg"))
    )
    # at most buckets-1 edges reach the driver, whatever the number of scores
    probs = [i / buckets for i in range(1, buckets)]
    edges = pts.agg(F.percentile_approx("score", probs, 10 * buckets).alias("e")).first()["e"] or []
    splits = [float("-inf"), *sorted({float(e) for e in edges}), float("inf")]
    pts = Bucketizer(splits=splits, inputCol="score", outputCol="_b").transform(pts)
    pts = pts.withColumn("_bin", F.col("_b").cast("int")).drop("_b")
    bins = pts.groupBy("_bin").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    # the bin table has at most ``buckets`` rows: one ordered window is fine
    above = Window.orderBy(F.col("_bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    carry = bins.select(
        "_bin",
        F.coalesce(F.sum("_bp").over(above), F.lit(0)).alias("_cp"),
        F.coalesce(F.sum("_bn").over(above), F.lit(0)).alias("_cn"),
        F.sum("_bp").over(every).alias("P"),
        F.sum("_bn").over(every).alias("N"),
    )
    inbin = Window.partitionBy("_bin").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    j = pts.join(F.broadcast(carry), "_bin")
    return j.select(
        "score", "pos", "neg", "P", "N",
        (F.col("_cp") + F.sum("pos").over(inbin)).alias("TP"),
        (F.col("_cn") + F.sum("neg").over(inbin)).alias("FP"),
    )


def roc_auc(points: DataFrame) -> DataFrame:
    """Exact area under the ROC curve (trapezoids between distinct scores)."""
    contrib = F.col("neg") * (F.col("TP") - F.col("pos") / 2.0)
    return points.agg(
        F.try_divide(F.sum(contrib), F.first("P").cast("double") * F.first("N").cast("double")).alias("roc_auc")
    )


def average_precision(points: DataFrame) -> DataFrame:
    """sum over thresholds of (R_n - R_{n-1}) * P_n."""
    contrib = F.col("pos") / F.col("P") * (F.col("TP") / (F.col("TP") + F.col("FP")))
    return points.agg(F.sum(contrib).alias("average_precision"))


def _fixed_point(points: DataFrame, **values: float) -> DataFrame:
    """The end of a curve that belongs to no score: one literal row, so the points
    are not computed a second time for it."""
    columns = [("threshold", "double"), *((name, "double") for name in values)]
    return literal_table(points.sparkSession, [(None, *values.values())], columns)


def roc_curve(points: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, plus the (0, 0) start
    with a null threshold (all intermediate points kept)."""
    pts = points.select(
        F.col("score").alias("threshold"),
        (F.col("FP") / F.col("N")).alias("fpr"),
        (F.col("TP") / F.col("P")).alias("tpr"),
    )
    return pts.unionByName(_fixed_point(points, fpr=0.0, tpr=0.0))


def pr_curve(points: DataFrame) -> DataFrame:
    """(threshold, precision, recall) down to the first threshold reaching full
    recall, plus the final (precision 1, recall 0) point with a null threshold."""
    kept = points.filter(F.col("TP") - F.col("pos") < F.col("P"))
    pts = kept.select(
        F.col("score").alias("threshold"),
        (F.col("TP") / (F.col("TP") + F.col("FP"))).alias("precision"),
        (F.col("TP") / F.col("P")).alias("recall"),
    )
    return pts.unionByName(_fixed_point(points, precision=1.0, recall=0.0))


def threshold_sweep(df: DataFrame, y="y_true", p="y_prob", thresholds=SWEEP) -> DataFrame:
    """accuracy, F1, precision, recall (1e-9 guards) at each threshold.

    Each row is placed in the bin "number of thresholds <= p" by exact
    comparisons; one aggregate over the bins and a cumulative sum over at most
    len(thresholds)+1 rows give the counts at every threshold.
    """
    spark: SparkSession = df.sparkSession
    n_bin = sum((F.col(p) >= F.lit(t)).cast("int") for t in thresholds)
    t = F.col(y) == 1
    per_bin = df.groupBy(n_bin.alias("bin")).agg(F.count_if(t).alias("pos"), F.count_if(~t).alias("neg"))
    grid = literal_table(
        spark, [(i + 1, float(thr)) for i, thr in enumerate(thresholds)] + [(0, None)], [("bin", "int"), ("thr", "double")]
    )
    full = grid.join(per_bin, "bin", "left").na.fill(0, ["pos", "neg"])
    # at most len(thresholds)+1 rows
    at_or_above = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    c = full.select(
        "bin", "thr",
        F.sum("pos").over(at_or_above).alias("tp"),
        F.sum("neg").over(at_or_above).alias("fp"),
        F.sum("pos").over(every).alias("P"),
        F.sum("neg").over(every).alias("N"),
    ).filter(F.col("bin") >= 1)
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("P") - tp
    tn = F.col("N") - fp
    return c.select(
        F.col("bin").alias("idx"),
        F.bround(F.col("thr"), 2).alias("threshold"),
        F.col("thr").alias("_thr"),
        ((tp + tn) / (F.col("P") + F.col("N"))).alias("accuracy"),
        _ratio((2 * tp).cast("double"), 2 * tp + fp + fn).alias("f1"),
        (tp / (tp + fp + F.lit(1e-9))).alias("precision"),
        (tp / (tp + fn + F.lit(1e-9))).alias("recall"),
    )


def best_threshold(sweep: DataFrame, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Threshold with the highest F1 (ties: the lowest threshold); ``default``
    when every F1 is 0."""
    best = sweep.agg(
        F.max_by(F.col("threshold"), F.struct(F.col("f1"), -F.col("idx"))).alias("_thr"),
        F.max("f1").alias("best_f1"),
    )
    return best.select(
        F.when(F.col("best_f1") > 0, F.col("_thr")).otherwise(F.lit(default)).alias("best_threshold"),
        "best_f1",
    )


def calibration(df: DataFrame, y="y_true", p="y_prob") -> DataFrame:
    """10 uniform right-closed bins: mean prediction and positive share; empty bins dropped."""
    b = sum((F.col(p) > F.lit(e)).cast("int") for e in CAL_EDGES)
    return df.groupBy(b.alias("bin")).agg(
        F.avg(F.col(p)).alias("mean_predicted"),
        F.avg(F.col(y).cast("double")).alias("fraction_positive"),
        F.count(F.lit(1)).alias("n"),
    )


def regression_metrics(df: DataFrame, step: str = "step", y: str = "y_true", yhat: str = "y_pred") -> DataFrame:
    """MAE, RMSE and R2 (1 - SSE/SST around the group mean) per step and over
    all steps flattened ('overall'), from one pass: both kinds of row are groups
    of one grouping-sets aggregate."""
    err = F.col(yhat) - F.col(y)
    pairs = df.select(
        F.concat(F.lit("+"), F.col(step).cast("string"), F.lit("h")).alias("_step"), F.col(y).alias("_y"), err.alias("_err")
    )
    e = F.col("_err")
    out = pairs.rollup("_step").agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop("_y") * F.count("_y"))).alias("r2"),
        F.count(F.lit(1)).alias("n"),
        F.grouping("_step").alias("_all"),
    )
    return out.select(F.when(F.col("_all") == 1, F.lit("overall")).otherwise(F.col("_step")).alias("step"), "mae", "rmse", "r2", "n")


def forecast_band(df: DataFrame, mae: float, yhat: str = "y_pred") -> DataFrame:
    """Adds ``lower`` and ``upper``: the forecast less and plus the model's overall MAE."""
    return df.withColumns({"lower": F.col(yhat) - F.lit(mae), "upper": F.col(yhat) + F.lit(mae)})


def step_bars(metrics: DataFrame) -> DataFrame:
    """Bar height per step: round(mae / (1.2 * max mae) * 100); ``metrics`` has
    one row per forecast step, so the whole-table window is tiny."""
    m = metrics.filter(F.col("step") != "overall")
    top = F.max("mae").over(Window.partitionBy())
    return m.select("step", "mae", F.floor(F.col("mae") / (F.lit(1.2) * top) * 100 + 0.5).cast("int").alias("bar_pct"))
