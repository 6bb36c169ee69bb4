"""Plan shape: no single-partition exchange and no Python UDF in core features."""

from stratocast.plans.clean import clean_series
from stratocast.plans.features import build_features
from stratocast.sources.tables import load, obs_hourly


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_plan_has_no_single_partition_or_python(spark, sf):
    f = build_features(clean_series(obs_hourly(load(spark, sf, "events"))), threshold=48.0)
    text = _plan(f)
    assert "SinglePartition" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_scan_prunes_columns_and_pushes_filters(spark, sf):
    from pyspark.sql import functions as F

    ev = load(spark, sf, "events").filter(F.col("value") > 10).select("user_id", "value")
    text = _plan(ev)
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,10.0)]" in text
    assert "ReadSchema: struct<user_id:bigint,value:double>" in text


def test_autocorrelation_plan_is_partitioned_and_jvm_only(spark, sf):
    from stratocast.operators import windows

    a = windows.autocorrelation(obs_hourly(load(spark, sf, "events")), "temperature", 48)
    text = _plan(a)
    assert "SinglePartition" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    # one correlation aggregate keyed by (location, lag), combined map-side
    assert "partial_" in text
