"""Operator 2: exact deduplication by exchanging Golomb-coded fingerprints.

1. Every source block (a bounded run of rows of one scan task) sorts the 64-bit
   hashes of its texts and sends each owner - a range of the hash space - the
   distinct ones, Golomb-coded, with a bit for those it holds more than once.
   A text that fills a block is one number there, so no owner gets more than one
   number a block for it.  Blocks are written to the shared folder: ids and
   digests stay in them, owners read only the codes.
2. Owners answer each block with a bitmap of the hashes that occur elsewhere
   or more than once.
3. Rows so marked are suspects.  Only their texts are shuffled: a bitmap of the
   suspects' hashes (at most ``BITMAP`` bits, whatever the input) lets other rows
   stay where they are, texts are grouped by their bytes with map-side combining,
   and a semi-join removes what passed the bitmap by chance.
4. Hashes that turn out to stand for several texts (none in practice) are
   settled by grouping and joining on the texts themselves.

Texts are equal when identical after no change; null counts as empty.  The row
with the largest doc_id stays (null ids last).  Repeated rows, also of one
doc_id, count each.  An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..session import materialize
from . import golomb
from .registry import id_text

#: Rows of one source block.
BLOCK_ROWS = 250_000
#: Most bits of the bitmap of suspects' hashes.
BITMAP = 1 << 24
SPACE = 1 << 64


def _fingerprint(text: Column) -> Column:
    return F.xxhash64(text)


def _owner_low(owner: int, owners: int) -> int:
    return -(-owner * SPACE // owners)


def blocks(rows: DataFrame, owners: int) -> DataFrame:
    """Messages of all source blocks: what owners read (code, repeated) and what stays (rows, doc_id, sha)."""

    def close(ids, hashes, shas):
        ids = pa.chunked_array(ids).combine_chunks()
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        h, ids, shas = h[order], ids.take(pa.array(order)), np.concatenate(shas)[order]
        name = uuid.uuid4().hex
        lows = [_owner_low(o, owners) for o in range(owners)] + [SPACE]
        cut = np.append(np.searchsorted(h, np.array(lows[:-1], np.uint64)), len(h))
        out = []
        for o in np.flatnonzero(np.diff(cut)).tolist():
            a, b = int(cut[o]), int(cut[o + 1])
            distinct, which, n = np.unique(h[a:b], return_inverse=True, return_counts=True)
            own = ids.slice(a, b - a)
            out.append(
                {
                    "block": name,
                    "owner": o,
                    "code": golomb.encode(distinct, lows[o], lows[o + 1]),
                    "repeated": np.packbits(n > 1).tobytes(),
                    "place": which.astype(np.int32).tobytes(),
                    "doc_id": own.to_pylist(),
                    "sha": b"".join(shas[a:b].tolist()),
                }
            )
        schema = pa.schema([("block", pa.string()), ("owner", pa.int32()), ("code", pa.binary()), ("repeated", pa.binary()), ("place", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("sha", pa.binary())])
        return pa.RecordBatch.from_pylist(out, schema=schema)

    def run(batches):
        ids, hashes, shas, n = [], [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column("doc_id"))
            hashes.append(batch.column("h").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            shas.append(np.array([bytes.fromhex(x) for x in batch.column("sha").to_pylist()], object))
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield close(ids, hashes, shas)
                ids, hashes, shas, n = [], [], [], 0
        if n:
            yield close(ids, hashes, shas)

    return rows.mapInArrow(run, "block string, owner int, code binary, repeated binary, place binary, doc_id array<long>, sha binary")


def replies(messages: DataFrame, owners: int) -> DataFrame:
    """Per message a bitmap: which of its hashes occur in another block or more than once."""

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        low = _owner_low(int(group["owner"].iloc[0]), owners)
        lists = [golomb.decode(c, low) for c in group["code"]]
        size = [len(x) for x in lists]
        every = np.concatenate(lists)
        again = np.concatenate([np.unpackbits(np.frombuffer(r, np.uint8), count=n) for r, n in zip(group["repeated"], size)]).astype(bool)
        _, which, n = np.unique(every, return_inverse=True, return_counts=True)
        again |= n[which] > 1
        ends = np.cumsum(size)
        return pd.DataFrame({"block": group["block"], "owner": group["owner"], "again": [np.packbits(again[e - s : e]).tobytes() for e, s in zip(ends, size)]})

    return messages.select("block", "owner", "code", "repeated").groupBy("owner").applyInPandas(answer, "block string, owner int, again binary")


def marked_rows(messages: DataFrame, answered: DataFrame, owners: int) -> DataFrame:
    """Rows as they were, with hash, digest and whether they are suspects."""

    def run(batches):
        for batch in batches:
            for m in batch.to_pylist():
                h = golomb.decode(m["code"], _owner_low(m["owner"], owners))
                again = np.unpackbits(np.frombuffer(m["again"], np.uint8), count=len(h)).astype(bool)
                place = np.frombuffer(m["place"], np.int32)
                sha = m["sha"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m["doc_id"], pa.int64()), pa.array(h[place].view(np.int64)), pa.array([sha[32 * i : 32 * i + 32].hex() for i in range(len(place))], pa.string()), pa.array(again[place])],
                    ["doc_id", "h", "sha", "suspect"],
                )

    joined = messages.select("block", "owner", "code", "place", "doc_id", "sha").join(answered, ["block", "owner"])
    return joined.mapInArrow(run, "doc_id long, h long, sha string, suspect boolean")


def suspect_filter(hashes: DataFrame, bits: int = BITMAP):
    """A UDF over hashes: false only for those that are no suspect's.  The bitmap
    is summed up in the cluster and has at most ``bits`` bits."""
    spark = hashes.sparkSession
    place = hashes.select(F.pmod(F.col("h"), F.lit(bits)).alias("place"))
    words = place.selectExpr("cast(place div 32 as int) AS word", "shiftleft(1L, cast(place % 32 as int)) AS bit")
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(bits // 32, np.uint32)
    table[got.column("word").to_numpy()] = got.column("bit").to_numpy().astype(np.uint32)
    shared = spark.sparkContext.broadcast(table)

    def may_be(h: pd.Series) -> pd.Series:
        place = h.to_numpy() % bits
        return pd.Series((shared.value[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1)

    return F.pandas_udf(may_be, BooleanType())


def exact_duplicates(docs: DataFrame, fingerprint=_fingerprint, bits: int = BITMAP) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = id_text(docs).withColumn("h", fingerprint(F.col("text")))
    messages = materialize(blocks(t.select("doc_id", "h", F.sha2("text", 256).alias("sha")), owners), "fingerprint-blocks")
    rows = materialize(marked_rows(messages, replies(messages, owners), owners), "marked-rows")

    suspects = rows.where("suspect")
    hashes = suspects.select("h").distinct()
    may_be = suspect_filter(hashes, bits)
    # copies are combined map-side before they are dealt by their hash
    by_text = t.where(may_be("h")).groupBy("h", "text").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id"))
    by_text = by_text.join(hashes, "h", "left_semi")
    groups = materialize(by_text.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.max("n").alias("n"), F.max("keep_id").alias("keep_id")), "text-groups")

    def out(df):
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return df.select("doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))

    alone = rows.where(~F.col("suspect")).select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    one = suspects.join(groups.where("texts = 1").select("h", "n", "keep_id"), "h")
    result = out(alone).unionByName(out(one))
    mixed = groups.where("texts > 1").select("h")
    if not mixed.isEmpty():  # one hash, several texts: by the texts themselves
        rest = t.join(mixed, "h", "left_semi")
        verdict = rest.groupBy("h", "text").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id"))
        settled = rest.withColumn("sha", F.sha2("text", 256)).join(verdict, ["h", "text"])
        result = result.unionByName(out(settled))
    return result
