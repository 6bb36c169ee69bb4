"""Structured Streaming jobs: observation ingest, rolling live features, scoring.

Sinks are idempotent: every micro-batch writes its own folders (``batch_id=N``;
the observation store under ``obs_day=D/batch_id=N``) with overwrite, so a
replayed batch replaces itself, and readers keep the newest version of each key
(``latest``).  Checkpoints live in
the shared checkpoint folder, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeparts import trunc_hour
from ..schema import KEY, TIME
from ..sources.tables import hourly_measures, location_of

# Rows of history a live feature reaches back (the row itself and 24 before it).
HALO_ROWS = 25


def observation_stream(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Streaming hourly observations per location from raw events.

    Duplicated deliveries (same event_id) inside the lateness bound are dropped;
    hourly windows keep state only until the watermark passes them.
    """
    deduped = (
        events.withColumn("_et", utc_instant(F.col("ts")))
        .withWatermark("_et", lateness)
        .dropDuplicatesWithinWatermark(["event_id"])
    )
    # the window on the instant drives state eviction; the NTZ hour is the
    # same hour as a wall-clock value for the output
    agg = deduped.groupBy(
        location_of(F.col("user_id")), F.window("_et", "1 hour").alias("w"), trunc_hour(F.col("ts")).alias(TIME)
    ).agg(*hourly_measures())
    return agg.drop("w")


def utc_instant(ts_ntz):
    """A UTC wall-clock TIMESTAMP_NTZ as an instant (TIMESTAMP), independent of
    the session zone; watermarks need the instant type."""
    return F.make_timestamp(
        F.year(ts_ntz), F.month(ts_ntz), F.dayofmonth(ts_ntz), F.hour(ts_ntz), F.minute(ts_ntz),
        F.date_part(F.lit("SECOND"), ts_ntz), F.lit("UTC"),
    )


# Partition columns of the versioned observation store (no leading underscore:
# Spark skips folders named ``_...`` as hidden).
DAY = "obs_day"
VERSION = "batch_id"


def versioned_writer(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink for the observation store, laid out ``obs_day=D/batch_id=N``.

    Dynamic partition overwrite replaces exactly the (day, batch) folders of this
    batch, so a replayed batch replaces itself; readers that need a time range
    prune to its day folders instead of listing every batch ever written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn(DAY, F.to_date(F.col(TIME)))
            .withColumn(VERSION, F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(DAY, VERSION)
            .parquet(path)
        )

    return write


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of each key across all batch folders (an aggregate:
    partial max_by per key, no window over a key's history)."""
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in keys and c not in (VERSION, DAY)]
    newest = F.max_by(F.struct(*rest), F.col(VERSION)).alias("_v")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col("_v")[c].alias(c) for c in rest])


@contextmanager
def without_no_data_batches(spark: SparkSession):
    """Start queries inside this block without no-data micro-batches.

    A no-data batch only advances the watermark and evicts state; in update mode
    it emits no rows, and the next data batch evicts the same state.  A query
    copies the session settings when it starts, so the setting is restored right
    after ``start()`` and other work in the session is unaffected.
    """
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def start_available_now(spark: SparkSession, writer, skip_empty_batches: bool = False):
    """``trigger(availableNow)``, start and wait; optionally without no-data batches."""
    writer = writer.trigger(availableNow=True)
    if skip_empty_batches:
        with without_no_data_batches(spark):
            q = writer.start()
    else:
        q = writer.start()
    q.awaitTermination()
    return q


def file_stream(spark: SparkSession, source_dir: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet file stream; ``files_per_trigger`` None = all new files per batch."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(source_dir)


def run_ingest(
    spark: SparkSession,
    source_dir: str,
    sink_dir: str,
    checkpoint: str,
    schema,
    files_per_trigger: int | None = None,
    skip_empty_batches: bool = False,
) -> None:
    """Process every file present in ``source_dir`` and not yet seen by the
    checkpoint (availableNow) into the versioned observation table at ``sink_dir``."""
    events = file_stream(spark, source_dir, schema, files_per_trigger)
    writer = (
        observation_stream(events)
        .writeStream.outputMode("update")
        .foreachBatch(versioned_writer(sink_dir))
        .option("checkpointLocation", checkpoint)
    )
    start_available_now(spark, writer, skip_empty_batches)


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """A versioned store, or None if nothing has been written yet; any other error is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
