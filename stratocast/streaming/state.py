"""Recent rows of each location as keyed state of a streaming query.

The observation store is a log of versions: each micro-batch of the ingest adds the hours
it changed.  This second query follows the log and keeps, per location, the newest rows in
list state; for every location that a micro-batch touches it hands on the touched rows and
the rows before them that features reach.  So a micro-batch reads the new files and the
state of the locations in them, whatever the store holds and however young a location is.
State per location is bounded (``ROWS_HELD`` rows) and goes when a location is silent for
``ttl``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import windows
from ..operators.series import join_null_safe
from ..schema import KEY, TIME
from .ingest import DAY, HALO_ROWS, VERSION, start_available_now

#: Hours that the ingest may still change, and rows held: those and the rows their features reach.
OPEN_HOURS = 3
ROWS_HELD = HALO_ROWS + OPEN_HOURS
_EPOCH = "1970-01-01"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RecentRows(StatefulProcessor):
    """State per location: its newest rows (``t`` in microseconds, version, measures) and how many hours it had so far.

    Of an hour's versions the highest counts, in one micro-batch and across them.  An hour
    that is not held is new: hours behind all held ones are beyond the ingest's watermark,
    so no later version of them can come."""

    def __init__(self, values: list[str], held: int, ttl: timedelta | None):
        self.values, self.held, self.ttl = values, held, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        cells = [T.StructField(v, T.DoubleType()) for v in self.values]
        ms = int(self.ttl.total_seconds() * 1000) if self.ttl else None
        self.rows = handle.getListState("rows", T.StructType([T.StructField("t", T.LongType()), T.StructField("version", T.LongType()), *cells]), ttlDurationMs=ms)
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("hours", T.LongType())]), ttlDurationMs=ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = ["t", "version", *self.values]
        newest = {r[0]: tuple(r) for r in self.rows.get()}
        before, touched = set(newest), set()
        # plain tuples: frames would cost more than the few rows of a key in them
        for frame in rows:
            for row in zip(*(frame[c].tolist() for c in columns)):
                t = row[0]
                touched.add(t)
                if t not in newest or row[1] >= newest[t][1]:
                    newest[t] = row
        hours = int(self.seen.get()[0] if self.seen.exists() else 0) + len(touched - before)
        both = [newest[t] for t in sorted(newest)]
        known = lambda v: None if v is None or v != v else float(v)
        self.rows.put([(int(r[0]), int(r[1]), *map(known, r[2:])) for r in both[-self.held :]])
        self.seen.update((hours,))
        t, _, *cells = zip(*both)
        n, place = len(both), key[0]
        missing = place is None or place != place
        yield pd.DataFrame({
            KEY: pd.array([None] * n, dtype="Int64") if missing else pd.arrays.IntegerArray(np.full(n, place, "int64"), np.zeros(n, "bool")),
            "t": np.array(t, "int64"), **{v: np.array(c, "float64") for v, c in zip(self.values, cells)},
            "touched": np.fromiter((x in touched for x in t), "bool", n), "n_rows": np.full(n, hours, "int64"),
        })

    def close(self) -> None:
        pass


def with_recent_rows(log: DataFrame, values: list[str], ttl: timedelta | None = None) -> DataFrame:
    """Stream of the store's log -> per micro-batch and touched location: its touched rows and the rows held before
    them (location, time, values, touched, n_rows: hours of the location so far)."""
    t = F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), F.col(TIME))
    rows = log.select(KEY, t.alias("t"), F.col(VERSION).cast("long").alias("version"), *[F.col(v).cast("double").alias(v) for v in values])
    schema = f"{KEY} long, t long, {', '.join(f'{v} double' for v in values)}, touched boolean, n_rows long"
    out = rows.groupBy(KEY).transformWithStateInPandas(
        statefulProcessor=RecentRows(values, ROWS_HELD, ttl), outputStructType=T.StructType.fromDDL(schema), outputMode="Update", timeMode="ProcessingTime" if ttl else "None"
    )
    when = F.timestamp_add("MICROSECOND", F.col("t"), F.lit(_EPOCH).cast("timestamp_ntz")).alias(TIME)
    return out.select(KEY, when, *values, "touched", "n_rows")


@contextmanager
def rocksdb(spark: SparkSession):
    """Start queries with list state inside this block: a query copies the session's state store when it starts."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, _PROVIDER)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def follow_store(spark: SparkSession, obs_dir: str, schema, checkpoint: str, write: Callable[[DataFrame, int], None], values: list[str], ttl: timedelta | None = None):
    """Hand every new file of the store's log to ``write`` (location rows as of ``with_recent_rows``, batch id), once,
    and stop.  ``schema`` is that of the store without its partition columns."""
    full = T.StructType([*schema.fields, T.StructField(DAY, T.DateType()), T.StructField(VERSION, T.LongType())])
    log = spark.readStream.schema(full).parquet(obs_dir)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        if not batch.isEmpty():
            write(batch, batch_id)
        batch.unpersist()

    writer = with_recent_rows(log, values, ttl).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
    with rocksdb(spark):
        return start_available_now(spark, writer, skip_empty_batches=True)


def feature_writer(out_dir: str) -> Callable[[DataFrame, int], None]:
    """Sink for live features: those of the newest row of each touched location, from the rows handed on."""

    def write(rows: DataFrame, batch_id: int) -> None:
        feats = windows.latest_features(rows.drop("touched", "n_rows")).drop("n_rows")
        seen = rows.groupBy(KEY).agg(F.max("n_rows").alias("n_rows"))
        counted = join_null_safe(feats, seen, [KEY])
        counted.write.mode("overwrite").parquet(f"{out_dir}/{VERSION}={batch_id}")

    return write


def scoring_writer(score: Callable[[DataFrame], DataFrame], out_dir: str) -> Callable[[DataFrame, int], None]:
    """Sink applying a fitted scorer to the rows handed on; scores of the touched hours are kept (idempotent by batch)."""

    def write(rows: DataFrame, batch_id: int) -> None:
        hours = rows.where("touched").select(KEY, TIME)
        scored = score(rows.drop("touched", "n_rows"))
        join_null_safe(scored, hours, [KEY, TIME]).write.mode("overwrite").parquet(f"{out_dir}/{VERSION}={batch_id}")

    return write


# what workers run here they get with the task: they need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
