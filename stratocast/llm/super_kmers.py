"""Operator 12: repeated passages removed, by super-k-mers dealt to buckets.

A window is ``window`` consecutive words of a document.  It repeats if its words also
start earlier: in a document of smaller doc_id, or earlier in the same one.

1. Blocks of documents (a bounded run of one scan task) sort their windows.  Windows
   that repeat one of the block are settled there; of equal ones only the first is
   sent on, so a passage that fills the corpus goes out once a block.
2. The minimiser of a window is the smallest hash of its stretches of ``M`` words.
   Consecutive windows that share it travel as one packed string of words - a
   super-k-mer - to the minimiser's bucket.  A block's strings for one bucket are one
   compressed message.  Stretches found in many documents of a bounded sample rank
   behind all others: windows over the edge of a common passage go where their own
   words send them.  The sample only spreads work; any choice gives the same rows.
3. A bucket sorts the windows it got, part by part of its minimisers, compares those of
   equal hash word by word, and returns the ranges of windows that stand behind an equal
   one.  A part takes a bounded number of words at a time; only windows not yet beaten
   are carried on.
4. Documents meet their ranges, and words that such windows cover are dropped.

The number of buckets follows the bytes of the table.  Words are those of ``words``.
Null text counts as empty, texts of under ``window`` words have no window, a null
doc_id is larger than all others.  Documents under one doc_id are ordered by a hash of
their texts; rows equal in both are one document, listed as often as in the input,
and don't repeat each other.  An empty table gives an empty result; other columns are
ignored.  A text is held whole by one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import words as W
from .exact_dedup import suspect_filter
from .registry import id_text, map_arrow

WINDOW = 20
#: Words of the stretches among which minimisers are chosen.
M = 4
#: Bytes of text of one block, and of text per bucket.
BLOCK, BUCKET = 3 << 20, 4 << 20
#: Parts of a bucket, by minimiser, that are compared one after another.
PARTS = 6
#: Documents of the sample, and the share of them from which a stretch ranks last.
SAMPLE, COMMON = 4_000, 0.005
#: Words that a part compares at once, and bytes of messages that are opened once and held.
AT_ONCE, HELD = 1_000_000, 32 << 20


def first_equal(t: W.Tokens, at: np.ndarray, window: int) -> np.ndarray:
    """For each window (by its first word) the index, in ``at``, of the first that has the same words."""
    if not len(at):
        return np.zeros(0, np.int64)
    key = W.rolling(t.h, window)[at]
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    first = np.empty(len(at), np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.flatnonzero(first != np.arange(len(at)))
    one, other = at[later], at[first[later]]
    run, size = stretches(one, one - other)  # windows in a row that repeat windows in a row: one comparison
    text = t.buf.tobytes()
    last = size + window - 2
    ends = zip(t.starts[one[run]].tolist(), t.ends[one[run] + last].tolist(), t.starts[other[run]].tolist(), t.ends[other[run] + last].tolist())
    if all(text[a:b] == text[c:d] for a, b, c, d in ends):
        return first
    # equal hashes of different windows: by the words themselves
    _, index, which = np.unique(t.numbers()[at[:, None] + np.arange(window)], axis=0, return_index=True, return_inverse=True)
    return index[which.ravel()]


def minimisers(h: np.ndarray, window: int, common: np.ndarray, m: int = M) -> np.ndarray:
    """Per window the smallest scrambled hash of its stretches of m words; common ones come last."""
    g = W.mixed(W.rolling(h, m)) >> np.uint64(1)
    if len(common) and len(g):
        near = np.minimum(np.searchsorted(common, g), len(common) - 1)
        g = g | ((common[near] == g).astype(np.uint64) << np.uint64(63))
    width, span = 1, window - m + 1
    while 2 * width <= span:
        g = np.minimum(g[:-width], g[width:])
        width *= 2
    return np.minimum(g[: len(g) - (span - width)], g[span - width :])


def stretches(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive places of one key: index of the first of each stretch, and how many."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (key[1:] != key[:-1])]))
    return new, np.diff(np.append(new, len(at)))


# --- messages: documents, stretches of their windows, and the stretches' words ----------

_DOC = (("lost", np.uint8), ("doc_id", np.int64), ("h", np.int64))
_STRETCH = (("own", np.uint32), ("start", np.uint32), ("count", np.uint32))
_COLUMNS = ("lost", "doc_id", "h", "start", "count")


def packed(columns: dict[str, np.ndarray], own: np.ndarray, text: bytes = b"") -> bytes:
    """``own`` numbers the document (in ``columns``) of each stretch; equal ones stand together."""
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    held = {**{c: columns[c][own[new]] for c, _ in _DOC}, "own": np.repeat(np.arange(len(new)), np.diff(np.append(new, len(own)))), "start": columns["start"], "count": columns["count"]}
    return b"".join([np.array([len(new), len(own)], np.int64).tobytes(), *(held[c].astype(t).tobytes() for c, t in _DOC + _STRETCH), text])


def unpacked(body: bytes) -> tuple[dict[str, np.ndarray], bytes]:
    """Per stretch its document's columns, start and count; and the words."""
    docs, n = np.frombuffer(body, np.int64, 2).tolist()
    at, held = 16, {}
    for (c, t), size in zip(_DOC + _STRETCH, [docs] * 3 + [n] * 3):
        held[c] = np.frombuffer(body, t, size, at)
        at += size * np.dtype(t).itemsize
    own = held["own"]
    return {**{c: held[c][own] for c, _ in _DOC}, "start": held["start"].astype(np.int64), "count": held["count"].astype(np.int64)}, body[at:]


def message(parts: list[bytes]) -> bytes:
    sizes = np.array([len(p) for p in parts], np.int64)
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.array([len(parts)], np.int64).tobytes(), sizes.tobytes(), *parts]))


def opened(sent: bytes) -> list[bytes]:
    body = zstandard.ZstdDecompressor().decompress(sent)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    ends = 8 + 8 * n + np.concatenate([[0], np.cumsum(np.frombuffer(body, np.int64, n, 8))])
    return [body[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


def _take(columns: dict, which) -> dict:
    return {c: v[which] for c, v in columns.items()}


def block_messages(columns: dict, texts: list[bytes], buckets: int, common: np.ndarray, window: int):
    """Messages of one block: (bucket, kind, body); kind 1 has super-k-mers, kind 0 the ranges already known to repeat."""
    order = np.lexsort((columns["h"], columns["doc_id"], columns["lost"]))
    columns = _take(columns, order)
    once = np.ones(len(order), bool)
    once[1:] = (columns["lost"][1:] != columns["lost"][:-1]) | (columns["doc_id"][1:] != columns["doc_id"][:-1]) | (columns["h"][1:] != columns["h"][:-1])
    columns = _take(columns, once)
    t = W.Tokens([texts[i] for i in order[once].tolist()])
    n = t.count
    doc_start = np.cumsum(n) - n
    size = np.maximum(n - window + 1, 0)
    at = W.spans(doc_start, size)
    doc = np.repeat(np.arange(len(n)), size)
    again = first_equal(t, at, window) != np.arange(len(at))
    if again.any():
        first, count = stretches(at[again], doc[again])
        own, start = doc[again][first], at[again][first]
        yield int(columns["h"][0]) % buckets, 0, message([packed({**columns, "start": start - doc_start[own], "count": count}, own)])
    at, doc = at[~again], doc[~again]
    if not len(at):
        return
    key = minimisers(t.h, window, common)[at]
    first, count = stretches(at, key)
    place = W.mixed(key[first]) % np.uint64(buckets * PARTS)  # bucket, then part
    order = np.argsort(place, kind="stable")
    first, count, place = first[order], count[order], place[order].astype(np.int64)
    begin, own = at[first], doc[first]
    start = begin - doc_start[own]
    text = t.buf.tobytes()
    low, high = t.starts[begin], t.ends[begin + count + window - 2]

    def part(a, b):
        if a == b:
            return b""
        words = b" ".join([text[x:y] for x, y in zip(low[a:b].tolist(), high[a:b].tolist())])
        return packed({**columns, "start": start[a:b], "count": count[a:b]}, own[a:b], words)

    for bucket in np.unique(place // PARTS).tolist():
        cuts = np.searchsorted(place, np.arange(bucket * PARTS, (bucket + 1) * PARTS + 1)).tolist()
        yield bucket, 1, message([part(a, b) for a, b in zip(cuts, cuts[1:])])


def settled(kmers: dict, text: bytes, window: int) -> tuple[dict, dict, bytes]:
    """Of super-k-mers: the ranges of windows that repeat an earlier one; and what is left, as super-k-mers and their words."""
    order = np.lexsort((kmers["start"], kmers["h"], kmers["doc_id"], kmers["lost"]))
    size = kmers["count"] + window - 1
    begin = (np.cumsum(size) - size)[order]
    kmers = _take(kmers, order)
    t = W.Tokens([text])
    at = W.spans(begin, kmers["count"])
    own = np.repeat(np.arange(len(order)), kmers["count"])
    start = W.spans(kmers["start"], kmers["count"])
    first = first_equal(t, at, window)
    beaten = first != np.arange(len(at))
    # a row that stands there twice is no copy of itself
    same = start == start[first]
    for c, _ in _DOC:
        same &= kmers[c][own] == kmers[c][own[first]]

    def of(which):
        f, count = stretches(at[which], own[which])
        mine = own[which][f]
        return {**{c: kmers[c][mine] for c, _ in _DOC}, "start": start[which][f], "count": count}, at[which][f]

    repeated, _ = of(beaten & ~same)
    left, places = of(~beaten)
    low, high = t.starts[places], t.ends[places + left["count"] + window - 2]
    held = t.buf.tobytes()
    return repeated, left, b" ".join([held[a:b] for a, b in zip(low.tolist(), high.tolist())])


def part_ranges(bodies, window: int, at_once: int = AT_ONCE):
    """Ranges of repeating windows of one part of a bucket, some words at a time."""
    columns, texts, n = [], [], 0

    def settle():
        merged = {c: np.concatenate([p[c] for p in columns]) for c in _COLUMNS}
        return settled(merged, b" ".join(t for t in texts if t), window)

    for body in bodies:
        if not body:
            continue
        c, text = unpacked(body)
        if n >= at_once:
            repeated, left, held = settle()
            yield repeated
            columns, texts, n = [left], [held], 0
        columns.append(c)
        texts.append(text)
        n += int(c["count"].sum()) + (window - 1) * len(c["h"])
    if columns:
        yield settle()[0]


def bucket_ranges(messages: list[bytes], window: int, at_once: int = AT_ONCE):
    """Ranges of repeating windows from a bucket's messages (kind 1), part by part."""
    held = [opened(m) for m in messages] if sum(map(len, messages)) <= HELD else None
    for k in range(PARTS):
        yield from part_ranges((one[k] for one in held) if held is not None else (opened(m)[k] for m in messages), window, at_once)


def common_stretches(texts: DataFrame, rows: int, m: int = M) -> np.ndarray:
    """Scrambled hashes of stretches of m words that at least COMMON of a bounded sample of documents hold."""
    part = texts if rows <= SAMPLE else texts.sample(fraction=SAMPLE / rows, seed=17)

    def run(batches):
        for batch in batches:
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                g = np.unique(W.mixed(W.rolling(W.Tokens([t]).h, m)) >> np.uint64(1))
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64))], ["g"])

    least = max(8, int(COMMON * min(rows, SAMPLE)))
    # each stands at `least` places of the sample: bounded by its words
    got = map_arrow(part.select("text"), run, "g long").groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("g").toArrow()
    return np.sort(got.column("g").to_numpy().astype(np.int64)).view(np.uint64)


def drop_repeated(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK, bucket_bytes: int = BUCKET, at_once: int = AT_ONCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (its words that no repeating window covers, joined by a space)."""
    spark = docs.sparkSession
    t = id_text(docs, id_col, text_col)
    rows, total = t.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    if not rows:
        return spark.createDataFrame([], "doc_id long, n_words long, n_removed long, kept string")
    buckets = max(1, -(-int(total) // bucket_bytes))
    common = spark.sparkContext.broadcast(common_stretches(t, rows))
    t = t.withColumn("h", F.xxhash64("text"))

    def send(batches):
        def close():
            columns = {"lost": pa.concat_arrays(ids).is_null().to_numpy(zero_copy_only=False), "doc_id": pa.concat_arrays(ids).fill_null(0).to_numpy(), "h": np.concatenate(hs)}
            out = list(block_messages(columns, texts, buckets, common.value, window))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "kind", "body"])

        ids, hs, texts, size = [], [], [], 0
        for batch in batches:
            column = batch.column("text").cast(pa.binary())
            for a in range(0, batch.num_rows, 50):
                part = column.slice(a, 50).to_pylist()
                ids.append(batch.column("doc_id").slice(a, 50))
                hs.append(batch.column("h").slice(a, 50).to_numpy())
                texts += part
                size += sum(map(len, part))
                if size >= block_bytes:
                    yield close()
                    ids, hs, texts, size = [], [], [], 0
        if texts:
            yield close()

    def receive(group: pd.DataFrame) -> pd.DataFrame:
        known = [unpacked(opened(b)[0])[0] for b in group["body"][group["kind"] == 0]]
        found = [*known, *bucket_ranges(group["body"][group["kind"] == 1].tolist(), window, at_once)]
        c = {k: np.concatenate([f[k] for f in found]) for k in _COLUMNS}
        return pd.DataFrame({"doc_id": pd.Series(c["doc_id"]).astype("Int64").mask(c["lost"] == 1), "h": c["h"], "first": c["start"], "last": c["start"] + c["count"] - 1})

    sent = map_arrow(t, send, "bucket long, kind int, body binary")
    ranges = sent.groupBy("bucket").applyInPandas(receive, "doc_id long, h long, first long, last long")
    # a document's own ranges, at most as many as it has words
    ranges = ranges.groupBy("doc_id", "h").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    ranges = materialize(ranges.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "ranges"), "ranges")

    def drop(batches):
        for batch in batches:
            column, r = batch.column("text").cast(pa.binary()), batch.column("ranges")
            for a in range(0, batch.num_rows, 50):
                lists = r.slice(a, 50)
                t = W.Tokens(column.slice(a, 50).to_pylist())
                begin = np.cumsum(t.count) - t.count
                own = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                each = lists.flatten()
                step = np.zeros(len(t.h) + 1, np.int64)
                np.add.at(step, begin[own] + each.field("first").to_numpy(), 1)
                np.add.at(step, begin[own] + each.field("last").to_numpy() + window, -1)
                stays = np.flatnonzero(np.cumsum(step[:-1]) == 0)
                doc = np.searchsorted(begin + t.count, stays, side="right")
                f, size = stretches(stays, doc)
                text = t.buf.tobytes()
                parts = [text[x:y] for x, y in zip(t.starts[stays[f]].tolist(), t.ends[stays[f] + size - 1].tolist())]
                cut = np.searchsorted(doc[f], np.arange(len(lists) + 1)).tolist()
                kept = [b" ".join(parts[x:y]) for x, y in zip(cut, cut[1:])]
                removed = t.count - np.bincount(doc, minlength=len(lists))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, 50), pa.array(t.count), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    # only documents that may have ranges are shuffled; others stay where they are
    may_have = suspect_filter(ranges.select(F.col("g").alias("h")))
    met = t.where(may_have("h")).join(ranges, t["doc_id"].eqNullSafe(ranges["d"]) & (t["h"] == ranges["g"]), "left").select("doc_id", "text", "ranges")
    alone = t.where(~may_have("h")).select("doc_id", "text", F.lit(None).cast("array<struct<first: long, last: long>>").alias("ranges"))
    return map_arrow(met.unionByName(alone), drop, "doc_id long, n_words long, n_removed long, kept string")
