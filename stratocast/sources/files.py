"""File sources and sinks: CSV (typed or header-normalised), partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quality import normalise_headers, nulls_for_nan

# Microsecond timestamps survive a CSV round trip only with an explicit format.
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV, no index, one folder of part files."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("timestampNTZFormat", TS_FORMAT)
        .csv(path)
    )


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a declared schema (no inference pass over the data); NaN is null."""
    return nulls_for_nan(
        spark.read.option("header", True)
        .option("timestampNTZFormat", TS_FORMAT)
        .schema(schema)
        .csv(path)
    )


def read_csv_normalised(spark: SparkSession, path: str, types: dict[str, T.DataType]) -> DataFrame:
    """CSV whose header may be padded or upper-case: names trimmed and
    lower-cased, then each known column cast to its declared type; NaN is null."""
    raw = normalise_headers(spark.read.option("header", True).csv(path))
    casts = []
    for c in raw.columns:
        t = types.get(c)
        if isinstance(t, T.TimestampNTZType):
            casts.append(F.to_timestamp_ntz(F.col(c), F.lit(TS_FORMAT)).alias(c))
        elif t is not None:
            casts.append(F.col(c).cast(t).alias(c))
        else:
            casts.append(F.col(c))
    return nulls_for_nan(raw.select(*casts))


def write_partitioned(df: DataFrame, path: str, by: list[str], fmt: str = "parquet") -> None:
    """One folder per value of ``by``.  Rows of a folder meet first, else every task would write a file into
    every folder; folders too large for one task are split among several (by their measured size)."""
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).format(fmt).save(path)


def read_partitioned(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """One scan over every partition folder (year=/month=/...); filters on the
    partition columns prune folders.  NaN is null."""
    return nulls_for_nan(spark.read.format(fmt).load(path))


def with_year_month(df: DataFrame, ts: str = "valid_time") -> DataFrame:
    return df.withColumns({"year": F.year(F.col(ts)), "month": F.month(F.col(ts))})
