"""Operator 5: token ids as a binary file format with a shared zstandard dictionary.

Documents are sorted by id over the whole table (range partitions), encoded, and
each document's ids become one zstandard frame of its own, compressed with a
dictionary trained on id arrays.  Frames are gathered into blocks:

    magic "TKB1" | bytes an id (u8) | dictionary hash (8 bytes) | documents (u32)
    | doc_id i64[n] | tokens u64[n] | frame offset u64[n + 1] | frames

A store is two folders below one path, both written by Spark's own committer, so
any file system that Spark writes will do and a lost executor leaves no half
file: ``blocks`` (one row a block: partition, place, first and last id, tokens,
block) and ``dictionary`` (hash and bytes).  The offset index gives one short
document without decompressing its neighbours (``fetch``).

The dictionary is trained on a bounded sample (``SAMPLE`` documents, ``HEAD``
ids of each); it changes sizes, never contents.

Defined cases: null text: empty, only the end id; null doc_id sorts first;
repeated ids are ordered by a hash of their text and each kept; an empty table
gives an empty store; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from .library_pieces import encoder
from .registry import bounded_sample, id_text, map_arrow

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
SAMPLE, HEAD, DICT_BYTES = 1_000, 4_096, 32_768
#: A block is closed at this many bytes of ids or documents.
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 4_096
LEVEL = 3
MAGIC = b"TKB1"
NO_ID = -(1 << 63)  # stands for a null doc_id in a block's index


def dictionary_hash(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:8]


def train_dictionary(docs: DataFrame, tokenizer: str = TOKENIZER) -> bytes:
    """A dictionary from a bounded sample of serialised id arrays; empty if there is too little to learn from."""

    def run(batches):
        e = encoder(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x[:HEAD].tobytes() for x in e.encode(batch.column("text").to_pylist())], pa.binary())], ["ids"])

    rows = map_arrow(bounded_sample(docs.select("text"), SAMPLE), run, "ids binary").collect()
    samples = [bytes(r["ids"]) for r in rows if r["ids"]]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, samples)) // 8), samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def pack_block(doc_ids: list[int | None], counts: list[int], frames: list[bytes], width: int, dict_hash: bytes) -> bytes:
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
    head = MAGIC + struct.pack("<B8sI", width, dict_hash, len(frames))
    ids = np.array([NO_ID if x is None else x for x in doc_ids], "<i8")
    return b"".join([head, ids.tobytes(), np.array(counts, "<u8").tobytes(), offsets.tobytes(), *frames])


class Block:
    """Reader of one block; ``ids(i)`` decompresses only document i."""

    def __init__(self, data: bytes, dictionary: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token block")
        width, dict_hash, n = struct.unpack_from("<B8sI", data, 4)
        if dict_hash != dictionary_hash(dictionary):
            raise ValueError("block was written with another dictionary")
        at = 4 + struct.calcsize("<B8sI")
        self.doc_ids = [None if x == NO_ID else x for x in np.frombuffer(data, "<i8", n, at).tolist()]
        self.counts = np.frombuffer(data, "<u8", n, at + 8 * n).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 16 * n).tolist()
        self.data, self.base, self.dtype = data, at + 16 * n + 8 * (n + 1), np.dtype(f"<u{width}")
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def ids(self, i: int) -> np.ndarray:
        frame = self.data[self.base + self.offsets[i] : self.base + self.offsets[i + 1]]
        return np.frombuffer(self.reader.decompress(frame), self.dtype)


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Write the store of all documents, in ascending doc_id order."""
    t = id_text(docs)
    spark = t.sparkSession
    dictionary = train_dictionary(t, tokenizer)
    spark.createDataFrame([(bytearray(dictionary_hash(dictionary)), bytearray(dictionary))], "hash binary, bytes binary").write.parquet(f"{path}/dictionary")

    def run(batches):
        e = encoder(tokenizer)
        if end_id >= 1 << 8 * e.dtype.itemsize:
            raise ValueError("end id does not fit")
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_checksum=False)
        writer = zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(compression_params=params)
        end = np.array([end_id], e.dtype).tobytes()
        part, place, start, size = TaskContext.get().partitionId(), 0, 0, 0
        ids, counts, frames = [], [], []

        def close():
            known = [x for x in ids if x is not None]
            return pa.RecordBatch.from_pylist(
                [{"part": part, "place": place, "first_id": min(known, default=None), "last_id": max(known, default=None), "start": start, "tokens": sum(counts), "block": pack_block(ids, counts, frames, e.dtype.itemsize, dictionary_hash(dictionary))}],
                schema=pa.schema([("part", pa.int32()), ("place", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("start", pa.int64()), ("tokens", pa.int64()), ("block", pa.binary())]),
            )

        for batch in batches:
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), e.encode(batch.column("text").to_pylist())):
                raw = x.tobytes() + end
                ids.append(doc_id)
                counts.append(len(x) + 1)
                frames.append(writer.compress(raw))
                size += len(raw)
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield close()
                    place, start, size = place + 1, start + sum(counts), 0
                    ids, counts, frames = [], [], []
        if ids:
            yield close()

    order = ["doc_id", F.xxhash64("text")]
    ranged = t.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = map_arrow(ranged, run, "part int, place long, first_id long, last_id long, start long, tokens long, block binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def _open(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row["bytes"])
    if bytes(row["hash"]) != dictionary_hash(dictionary):
        raise ValueError("the dictionary is damaged")
    return spark.read.schema("part int, place long, first_id long, last_id long, start long, tokens long, block binary").parquet(f"{path}/blocks"), dictionary


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32.

    Only the token totals of the partitions (one number each) meet on the driver."""
    blocks, dictionary = _open(spark, path)
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    sums = np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()
    base = dict(zip([p for p, _ in totals], sums))

    def run(batches):
        for batch in batches:
            for part, start, data in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "block"))):
                b = Block(data, dictionary)
                crc = [zlib.crc32(b.ids(i).astype("<u4")) for i in range(len(b.doc_ids))]
                first = base[part] + start + np.cumsum(b.counts) - b.counts
                yield pa.RecordBatch.from_arrays([pa.array(b.doc_ids, pa.int64()), pa.array(first, pa.int64()), pa.array(b.counts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("part", "start", "block").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of the documents with one id: the block statistics prune the files, the offset index the block."""
    blocks, dictionary = _open(spark, path)
    found = []
    for row in blocks.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).select("block").toLocalIterator():
        b = Block(bytes(row["block"]), dictionary)
        found += [b.ids(i).tolist() for i, x in enumerate(b.doc_ids) if x == doc_id]
    return found


def store_and_read(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Write a store into the shared folder and read it back."""
    spark = docs.sparkSession
    path = shared_path(spark, "token-store")
    write(docs, path, tokenizer, end_id)
    return read_index(spark, path)
