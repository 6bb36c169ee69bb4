"""Fits that end with their scan, even partitions, partitioned sinks of many folders, keyed state without a frame per key."""

import os

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from stratocast.operators import models
from stratocast.sources import files


def noisy(spark, n):
    h = F.xxhash64("id")
    return spark.range(n).select((h % 97).cast("double").alias("a"), (h % 89).cast("double").alias("b"), (F.xxhash64("id", F.lit(1)) % 2 == 0).cast("int").alias("rain_tomorrow"))


def fits(monkeypatch):
    grown, real = [], GBTClassifier._fit

    def fit(self, data):
        grown.append(self.getMaxIter())
        return real(self, data)

    monkeypatch.setattr(GBTClassifier, "_fit", fit)
    return grown


def test_trees_behind_the_end_of_the_scan_are_not_grown(spark, monkeypatch):
    train = noisy(spark, 400)
    valid = train.withColumn("rain_tomorrow", 1 - F.col("rain_tomorrow"))  # the more is learnt, the worse
    grown = fits(monkeypatch)
    m = models.fit_rain_classifier(train, ["a", "b"], valid=valid, max_iter=40, patience=2)
    assert max(grown) < 40 and m.iterations_run == max(grown) and m.best_iteration + 2 < m.iterations_run
    whole = models.fit_rain_classifier(train, ["a", "b"], max_iter=12)
    same = models.first_trees(whole.model.stages[1], m.best_iteration + 1)
    assert [t.toDebugString.split("\n", 1)[1] for t in m.model.stages[1].trees] == [t.toDebugString.split("\n", 1)[1] for t in same.trees]


def test_a_scan_that_goes_on_grows_all_trees(spark, monkeypatch):
    d = noisy(spark, 400).withColumn("rain_tomorrow", (F.col("a") > F.col("b")).cast("int"))
    grown = fits(monkeypatch)
    m = models.fit_rain_classifier(d, ["a", "b"], valid=d, max_iter=9, patience=2)
    assert grown == [4, 9] and m.iterations_run == 9 and m.best_iteration == 8


def test_training_rows_lie_in_even_partitions(spark, monkeypatch):
    monkeypatch.setattr(models, "PARTITION_BYTES", 2400)
    uneven = spark.range(1000).repartitionByRange(5, F.when(F.col("id") < 950, 0).otherwise(F.col("id"))).select("id", "id", "id")
    n = models.partitions_for(24_000, spark.sparkContext.defaultParallelism)
    sizes = models.by_bytes(uneven).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert n > 1 and len(sizes) == n and sum(sizes) == 1000 and max(sizes) <= 1000 / n + 5 * n


def test_partitions_follow_cores_and_bytes():
    mb = 1 << 20
    assert [models.partitions_for(s * mb, 12) for s in (0, 5, 8, 9, 90, 300, 768, 769, 2000)] == [1, 1, 1, 2, 12, 12, 12, 24, 36]


def test_partitioned_sink_writes_a_folder_from_one_task(spark, tmp_path):
    d = spark.range(4000).select((F.col("id") % 50).alias("k"), F.col("id").alias("v")).repartition(8)
    d = d.unionByName(spark.createDataFrame([(None, -1)], "k long, v long"))
    path = str(tmp_path / "p")
    files.write_partitioned(d, path, ["k"])
    count = sum(f.endswith(".parquet") for _, _, found in os.walk(path) for f in found)
    assert count == 51
    assert sorted(r["v"] for r in files.read_partitioned(spark, path).collect()) == [-1, *range(4000)]


class Held:
    """State of one key, as the processor uses it."""

    def __init__(self):
        self.value = []

    def get(self):
        return self.value

    def put(self, rows):
        self.value = rows

    update = put

    def exists(self):
        return bool(self.value)


def test_keyed_state_keeps_the_newest_version_of_an_hour(monkeypatch):
    import pandas as pd

    from stratocast.streaming import state

    p = state.RecentRows(["a", "b"], 3, None)
    p.rows, p.seen = Held(), Held()
    frame = lambda *rows: pd.DataFrame(rows, columns=["t", "version", "a", "b"])
    first = [frame((3, 0, 1.0, None), (1, 0, 2.0, 5.0)), frame((3, 0, 7.0, 8.0), (2, 0, 3.0, 1.0), (0, 0, 4.0, 4.0))]
    out = next(p.handleInputRows((None,), iter(first), None))
    assert out["t"].tolist() == [0, 1, 2, 3] and out["a"].tolist() == [4.0, 2.0, 3.0, 7.0] and out["location_id"].isna().all()
    assert out["touched"].all() and set(out["n_rows"]) == {4}
    assert p.rows.get() == [(1, 0, 2.0, 5.0), (2, 0, 3.0, 1.0), (3, 0, 7.0, 8.0)]
    # no frame is built of the state: that cost more than the rows
    real, built = pd.DataFrame, []
    monkeypatch.setattr(state.pd, "DataFrame", lambda *a, **k: built.append(1) or real(*a, **k))
    monkeypatch.setattr(state.pd, "concat", None)
    out = next(p.handleInputRows((9,), iter([real([(4, 1, None, 1.5), (3, 1, 6.0, None), (2, -1, 0.0, 0.0)], columns=["t", "version", "a", "b"])]), None))
    assert len(built) == 1 and out["location_id"].tolist() == [9] * 4 and set(out["n_rows"]) == {5}
    assert out["t"].tolist() == [1, 2, 3, 4] and out["touched"].tolist() == [False, True, True, True]
    assert out["a"].tolist()[:3] == [2.0, 3.0, 6.0] and out["a"].isna().tolist()[3] and out["b"].isna().tolist() == [False, False, True, False]
    assert p.rows.get() == [(2, 0, 3.0, 1.0), (3, 1, 6.0, None), (4, 1, None, 1.5)]
