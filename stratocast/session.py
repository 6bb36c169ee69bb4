"""Session construction and shared-folder helpers.

Everything in the library takes a SparkSession from the caller; this module only
builds one for tests, the bench and local runs, and finds the shared folder the
cluster names in ``spark.checkpoint.dir`` for intermediate tables.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every session we build gets.  AQE re-plans joins from runtime sizes
# (broadcast only when the measured side is small, split skewed partitions).
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # delete reliable-checkpoint files once their RDD is no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str = "local[8]",
    shuffle_partitions: int = 8,
    app_name: str = "stratocast",
    driver_memory: str = "8g",
    extra: dict | None = None,
) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a private one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared filesystem; we never
    override it.  Only local runs and tests, where it is unset, get a fresh
    folder from ``mkdtemp``; on any other master that would be a folder of one
    machine, so it is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="stratocast-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_GIVEN: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    _GIVEN.append(f"{base}/stratocast/{name}-{uuid.uuid4().hex[:12]}")
    return _GIVEN[-1]


@contextmanager
def own_tables(spark: SparkSession, keep: list[str]):
    """Delete the tables that the library writes within this block when it ends, but those named in
    ``keep`` by then.  For work whose result is written within the block."""
    mark = len(_GIVEN)
    try:
        yield
    finally:
        for path in [p for p in _GIVEN[mark:] if p not in keep]:
            delete_table(spark, path)


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete a table under ``shared_path`` that is no longer read."""
    if path not in _GIVEN:
        raise ValueError(f"{path} is no table of this application")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _GIVEN.remove(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing a Parquet table to the shared folder and reading it back.

    Survives executor loss (the files are on shared storage) and keeps long
    iterative plans short.  Use instead of ``localCheckpoint``.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable (eager) checkpoint into the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
