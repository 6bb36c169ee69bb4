"""Registered queries of this subpackage and the helpers they share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Rows of one Arrow batch handed to a Python worker (bounds worker memory when texts are long).
ARROW_ROWS = 500


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver found it: once
    per application it is zipped and handed to Spark, which serves it to executors."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(), "stratocast_workers.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def bound_batches(spark: SparkSession) -> None:
    """Lower the rows per Arrow batch to ARROW_ROWS unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), under fixed names: other columns of the
    input, whatever they are called, can't clash with what an operator adds."""
    ship(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def bounded_sample(df: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows, drawn over the whole table by a fixed seed.  (A bare limit
    would send that many rows of every partition to one task.)"""
    n = df.count()
    return df if n <= rows else df.sample(fraction=min(1.0, 1.2 * rows / n), seed=17).limit(rows)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def keep_rows(docs: DataFrame, judge: Callable[[list[str]], list[bool]], text_col: str = "text") -> DataFrame:
    """Rows whose text (null: empty) the judge keeps, columns as they are: one map, nothing is shuffled or joined."""
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(judge(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def text_chunks(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges [a, b) over texts of at most ``limit`` characters each (a longer text stands alone)."""
    a, size = 0, 0
    for b, t in enumerate(texts):
        if b > a and size + len(t) > limit:
            yield a, b
            a, size = b, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)
