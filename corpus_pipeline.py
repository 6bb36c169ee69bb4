"""The corpus pipeline: stages over ``documents``, each one of the numbered operators.

Every stage but the last returns the columns it was given, so stages can be
written and read again one by one.  A stage works on all that the one before it
kept:

1. language ID: texts without a language go (null, or no letters), and those
   whose prediction is no better than ``LANGUAGE_SCORE``;
2. quality: texts that the classifier predicts to be of label 0 go;
3. exact dedup: of equal texts the row with the largest doc_id stays;
4. near dedup: of each class of near-duplicates the row with the smallest doc_id stays;
5. packing of what is left into sequences: one row per piece.

The first two are filters: one map over the rows, in which each is judged by its text,
and nothing is shuffled but what the classifiers learn from.  The dedup stages tell rows
apart by their place in the stage's written input, not by doc_id: a repeated row is a
copy like any other, and rows without a doc_id stay like others.  Of rows that a stage
chooses between, one without a doc_id stays only if none has one; equal doc_ids are
told apart by the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocast.llm import bag_minhash, exact_dedup, language_id, packing, quality_cnn
from stratocast.llm.registry import ship
from stratocast.session import delete_table, materialize, own_tables, shared_path
from stratocast.sources.tables import load

#: Shares of the kernel score below which no language is believed.
LANGUAGE_SCORE = 0.35


#: Column of the row key.
ROW = "_row"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each row: its place (file and row) in the Parquet table that docs is.

    The place is the same however often and in whatever splits the rows are read; anything
    but a plain table is written first.  xxhash64 of a single long is one-to-one, so keys
    are unique; it spreads them over all bits."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = materialize(docs, "rows")
    columns = docs.columns
    placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    names = sorted(r["_file"] for r in placed.select("_file").distinct().collect())  # one row per file
    files = docs.sparkSession.createDataFrame(list(enumerate(names)), "_number long, _file string")
    return placed.join(F.broadcast(files), "_file").select(*columns, F.xxhash64(F.shiftleft("_number", 40) + F.col("_place")).alias(ROW))


def _by_row(keyed: DataFrame) -> DataFrame:
    """The key in the place of the id, and the text: what an operator then says, it says of a row."""
    return keyed.select(F.col(ROW).alias("doc_id"), "text")


def _dropped(keyed: DataFrame, grouped: DataFrame, group: str, order: list) -> DataFrame:
    """Keys of all rows but the first, in this order, of every group of rows (doc_id of ``grouped`` is the key)."""
    ids = keyed.select(ROW, F.col("doc_id").alias("_id"))
    named = grouped.select(F.col("doc_id").alias(ROW), F.col(group).alias("_group")).join(ids, ROW)
    first = named.groupBy("_group").agg(F.min_by(ROW, F.struct(*order, F.col(ROW))).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # two written tables in a sort-merge join: the adaptive plan splits a large group
    named, first = materialize(named, "grouped-rows"), materialize(first, "first-rows").hint("merge")
    return named.join(first, "_group").where(F.col(ROW) != F.col("_first")).select(ROW)


def _without(keyed: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows whose key is not among the dropped, without the key.  What is dropped is the smaller list; it is
    written first, so that the join is planned by its size."""
    return keyed.join(materialize(dropped, "dropped-rows"), ROW, "left_anti").drop(ROW)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs, language_id.learn(docs), LANGUAGE_SCORE)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_cnn.keep_good(docs, quality_cnn.learn(docs, load(spark, sf_dir, "labels")))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    found = exact_dedup.exact_duplicates(_by_row(keyed))
    largest = [F.col("_id").isNull(), -F.col("_id").cast("decimal(20,0)")]
    return _without(keyed, _dropped(keyed, found, "keep_id", largest))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    found = bag_minhash.near_duplicates(_by_row(keyed))
    smallest = [F.col("_id").isNull(), F.col("_id")]
    return _without(keyed, _dropped(keyed, found, "class_id", smallest))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_duplicates),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]
#: Three stages have no SQL form (two classifiers and a signature scheme); the tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages.  Once a stage's rows are written, the tables it worked with go, and those it read."""
    ship(spark)
    docs, last = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        with own_tables(spark, []):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        if last is not None:
            delete_table(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
