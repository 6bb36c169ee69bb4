"""Operator 6: near-duplicate documents by BagMinHash.

Weights (how often a shingle occurs) are laid on an axis cut into intervals
[0, 1), [1, 2), [2, 4), [4, 8) ...  Every shingle has, in every interval below
its weight, a Poisson process in time that depends on the shingle and the
interval alone; its points carry a register of the signature and a place on the
weight axis, and count if the place lies below the weight.  A register keeps the
first point that falls into it, so two documents agree in a register with the
probability of their weighted Jaccard similarity.  Points are drawn in order of
time and only up to the time by which all registers are filled.

Documents with equal multisets are one node.  Nodes that agree in all rows of a
band share a bucket; in each bucket members are compared with a pivot, on their
whole multisets.  Members that this connects with their pivot are done with in
that bucket; strangers to its component are then compared with all other members
of other components: as pairs in small buckets (each pair once, except pairs that
sizes or the triangle inequality of 1 - J rule out), as blocks of members in large
ones, where an overlap is an entry of a matrix product and not a row.  So a bucket
of copies costs one comparison each, a bucket of thousands of half-alike texts
never becomes rows for all its pairs, and no link that a bucket offers between
different components is left out.

Links: weighted Jaccard similarity of five-word shingles of at least 0.8.  Nulls
count as empty; texts without words link with nothing.  Repeated rows are each
returned; documents without an id take part as copies only.  An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import smallest_ids
from .exact_dedup import suspect_filter
from .piece_table import mix
from .registry import id_text, map_arrow, text_chunks
from .word_bags import ENTRY, bag_keys, counted, entries, overlaps, shared, shingles

SIMILARITY = 0.8
BANDS, ROWS = 24, 5
CHUNK = 600_000
#: Buckets up to this size are compared by pairs of rows, larger ones by blocks of members.
SMALL, BLOCK = 16, 256
#: Shingles, each as often as it stands there, of one side of a block on average (a larger document stands alone).
UNITS = 1 << 20
#: Columns of one matrix of a block.
COLUMNS = 1 << 12
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE, _REGISTER = np.uint64(0xD1B54A32D192ED03), np.uint64(0xA0761D6478BD642F)


def _uniform(h: np.ndarray) -> np.ndarray:
    """(0, 1] from 64 bits."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(doc: np.ndarray, shingle: np.ndarray, times: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """BagMinHash signatures (texts x registers); rows of texts without shingles are zero."""
    seeds, low, width, top, owner = [], [], [], [], []
    level, start = 0, 0
    while True:
        in_reach = times > start
        if not in_reach.any():
            break
        seeds.append(mix(shingle[in_reach] * np.uint64(2) + np.uint64(1) + mix(np.array([level], np.uint64))))
        w = 1 if level == 0 else start
        low.append(np.full(int(in_reach.sum()), start))
        width.append(np.full(int(in_reach.sum()), w))
        top.append(times[in_reach])
        owner.append(doc[in_reach])
        start, level = start + w, level + 1
    sig = np.zeros((texts, registers), np.uint64)
    if not seeds:
        return sig
    seed, low, width, top, owner = (np.concatenate(x) for x in (seeds, low, width, top, owner))
    weight = np.bincount(doc, times, texts)
    todo = np.flatnonzero(weight > 0)
    reach = np.zeros(texts)
    reach[todo] = (np.log(registers) + 3.0) / weight[todo]
    flat = sig.reshape(-1)
    active = np.ones(len(seed), bool)
    partly = top < low + width  # weights that end within the interval
    while len(todo):
        first = np.full(texts * registers, np.inf)
        s, cell0, until = seed[active], owner[active] * registers, reach[owner[active]]
        scale, low_, width_, top_, cut = 1.0 / (width[active] * registers), low[active], width[active], top[active], partly[active]
        t, step, size = np.zeros(len(s)), 1, 1
        while len(s):
            # a few points of each element at once, once few elements are left
            h = mix(s[:, None] + np.arange(step, step + size, dtype=np.uint64) * _STEP)
            when = np.log(_uniform(h))
            when *= -scale[:, None]
            when[:, 0] += t
            if size > 1:
                when = np.cumsum(when, axis=1)
            t = when[:, -1].copy()
            near = when <= until[:, None]
            if near.any():
                row = np.repeat(np.arange(len(s)), near.sum(1))
                h, at = h[near], when[near]
                if cut.any():
                    place = low_[row] + np.floor(_uniform(mix(h ^ _PLACE)) * width_[row] * (1 - 2.0**-53))
                    keep = place < top_[row]
                    row, h, at = row[keep], h[keep], at[keep]
                cell = cell0[row] + ((mix(h ^ _REGISTER) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
                np.minimum.at(first, cell, at)
                won = at == first[cell]
                flat[cell[won]] = h[won]
            alive = t <= until
            s, cell0, until, scale, t = s[alive], cell0[alive], until[alive], scale[alive], t[alive]
            low_, width_, top_, cut = low_[alive], width_[alive], top_[alive], cut[alive]
            step, size = step + size, 1 if len(s) > 4096 else 8
        full = np.isfinite(first.reshape(texts, registers)).all(1)
        todo = todo[~full[todo]]
        if len(todo):  # a register without a point yet: look further ahead
            reach[todo] *= 2
            again = np.zeros(texts, bool)
            again[todo] = True
            active = again[owner]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(sig), bands), np.uint64) + mix(np.arange(1, bands + 1, dtype=np.uint64))
    part = sig.reshape(len(sig), bands, rows)
    for k in range(rows):
        key = mix(key * _STEP + part[:, :, k])
    return key


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, hashes of the multiset (k1, k2), its size n, band keys (null without words)."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keys, sizes, sigs = [], [], []
            for a, b in text_chunks(texts, CHUNK):
                for c in range(a, b, 1 << 15):
                    part = texts[c : min(b, c + (1 << 15))]
                    doc, shingle, times = counted(shingles(part))
                    keys.append(bag_keys(doc, shingle, times, len(part)))
                    sizes.append(np.bincount(doc, times, len(part)).astype(np.int64))
                    sigs.append(band_keys(signatures(doc, shingle, times, len(part), bands * rows), bands, rows))
            k, n, s = np.concatenate(keys), np.concatenate(sizes), np.concatenate(sigs).view(np.int64)
            cut = np.arange(len(texts) + 1, dtype=np.int32) * bands
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(s.reshape(-1)), mask=pa.array(n == 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(k[:, 0].view(np.int64)), pa.array(k[:, 1].view(np.int64)), pa.array(n), lists],
                ["doc_id", "k1", "k2", "n", "bands"],
            )

    return map_arrow(id_text(docs), run, "doc_id long, k1 long, k2 long, n long, bands array<long>")


def bags(texts: DataFrame) -> DataFrame:
    """node, its multiset; rows (node, k1, k2, text) whose text has another multiset are not the node's."""

    def run(batches):
        for batch in batches:
            t, nodes = batch.column("text").to_pylist(), batch.column("node").to_pylist()
            k1, k2 = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
            out = []
            for a, b in text_chunks(t, CHUNK):
                held = counted(shingles(t[a:b]))
                found = bag_keys(*held, b - a).view(np.int64).tolist()
                out += [(nodes[a + i], bag.tobytes()) for i, bag in enumerate(entries(*held, b - a)) if found[i] == [k1[a + i], k2[a + i]]]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["node", "bag"])

    return map_arrow(texts, run, "node long, bag binary")


def overlap(pairs: DataFrame, bag: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, j): weighted Jaccard similarity of the whole multisets."""

    def run(batches):
        for batch in batches:
            j = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                a, b = np.frombuffer(x, ENTRY), np.frombuffer(y, ENTRY)
                both = shared(a, b)
                j.append(both / (int(a["times"].sum(dtype=np.int64)) + int(b["times"].sum(dtype=np.int64)) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(j, pa.float64())], ["u", "v", "j"])

    both = pairs.join(bag.select(F.col("node").alias("u"), F.col("bag").alias("x")), "u").join(bag.select(F.col("node").alias("v"), F.col("bag").alias("y")), "v")
    return map_arrow(both.select("u", "v", "x", "y"), run, "u long, v long, j double")


def _may_link(a: str, b: str, similarity: float):
    return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity)


def compare_blocks(group: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links between the members ``side`` 0 and ``side`` 1 of one bucket that lie in different components.

    A pair is looked at only in the first band it shares, so that buckets of the same
    documents don't repeat the work; overlaps are one matrix product over the shingles
    that both sides hold.  Of the links found those that connect are returned."""
    key = group["key"].iloc[0]
    a, b = (group[group["side"] == s] for s in (0, 1))
    if not len(a) or not len(b):
        return pd.DataFrame({"u": [], "v": []}, dtype="int64")
    an, bn, ac, bc = a["n"].to_numpy(), b["n"].to_numpy(), a["c"].to_numpy(), b["c"].to_numpy()
    ai, bi = a["node"].to_numpy(), b["node"].to_numpy()
    ab, bb = np.stack(a["bands"].to_numpy()), np.stack(b["bands"].to_numpy())
    band = int(np.flatnonzero(ab[0] == key)[0])
    todo = (ac[:, None] != bc[None, :]) & (np.minimum(an[:, None], bn) >= similarity * np.maximum(an[:, None], bn))
    todo &= ~(b["outside"].to_numpy()[None, :] & (ai[:, None] >= bi[None, :]))  # two outsiders meet twice
    for k in range(band):
        todo &= ab[:, k, None] != bb[None, :, k]
    rows, cols = np.flatnonzero(todo.any(1)), np.flatnonzero(todo.any(0))
    if not len(rows):
        return pd.DataFrame({"u": [], "v": []}, dtype="int64")
    left = [np.frombuffer(x, ENTRY) for x in a["bag"].to_numpy()[rows]]
    right = [np.frombuffer(x, ENTRY) for x in b["bag"].to_numpy()[cols]]
    overlap = overlaps(left, right, COLUMNS)
    j = overlap / (an[rows][:, None] + bn[cols][None, :] - overlap)
    u, v = np.nonzero((j >= similarity) & todo[np.ix_(rows, cols)])
    parent: dict[int, int] = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for x, y in zip(rows[u].tolist(), cols[v].tolist()):
        p, q = find(int(ac[x])), find(int(bc[y]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((int(ai[x]), int(bi[y])))
    return pd.DataFrame(out, columns=["u", "v"]).astype("int64")


def linked_nodes(nodes: DataFrame, bag_of, similarity: float = SIMILARITY, small: int = SMALL) -> DataFrame | None:
    """(id, component_id) of nodes (node, n, bands) that link with another; None if no bucket holds two."""
    banded = nodes.where(F.col("bands").isNotNull()).select("node", "n", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("units"), F.min(F.struct("node", "n")).alias("p")).where("size > 1")
    pivots = materialize(buckets.select("key", "size", "units", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n")), "pivots")
    # a sort-merge join of two scans: the adaptive plan splits the buckets of many members
    members = materialize(banded.join(pivots.hint("merge"), "key"), "bucket-members")
    if members.isEmpty():
        return None
    bag = materialize(bag_of(members.select("node").distinct()), "bags")

    pairs = members.where("node <> pivot").where(_may_link("n", "pivot_n", similarity)).select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    known = materialize(overlap(pairs, bag), "overlaps")
    linked = smallest_ids(known.where(F.col("j") >= similarity))

    # members outside their pivot's component, and all they have not been compared with
    names = linked.select(F.col("id").alias("node"), F.col("component_id").alias("c"))
    own = linked.select(F.col("id").alias("pivot"), F.col("component_id").alias("pc"))
    now = members.where("size > 2").join(names, "node", "left").withColumn("c", F.coalesce("c", "node"))
    now = materialize(now.join(own, "pivot", "left").withColumn("outside", F.col("c") != F.coalesce("pc", "pivot")).drop("pc"), "named-members")
    out_of = now.where("outside").groupBy("key").agg(F.count(F.lit(1)).alias("strangers"), F.sum("n").alias("stranger_units"))
    now = now.join(materialize(out_of, "strangers").hint("merge"), "key")  # two scans, as above
    now = materialize(now.where("node <> pivot").select("key", "size", "units", "strangers", "stranger_units", "pivot", "node", "n", "c", "outside"), "open-buckets")
    more = []

    # small buckets: pairs, each once however many buckets it shares
    few = now.where(F.col("size") <= small)
    to_pivot = known.select(F.col("u").alias("pivot"), F.col("v").alias("node"), (1 - F.col("j")).alias("d"))
    few = few.join(to_pivot, ["pivot", "node"], "left")
    a = few.where("outside").select("key", *(F.col(x).alias(f"a_{x}") for x in ("node", "n", "c", "d")))
    b = few.select("key", *(F.col(x).alias(f"b_{x}") for x in ("node", "n", "c", "d", "outside")))
    near = F.coalesce(F.abs(F.col("a_d") - F.col("b_d")) <= 1 - similarity + 1e-9, F.lit(True))
    rest = a.join(b, "key").where("a_c <> b_c AND (NOT b_outside OR a_node < b_node)").where(_may_link("a_n", "b_n", similarity)).where(near)
    pairs = rest.select(F.least("a_node", "b_node").alias("u"), F.greatest("a_node", "b_node").alias("v")).distinct()
    pairs = materialize(pairs.join(known, ["u", "v"], "left_anti"), "rest-pairs")
    if not pairs.isEmpty():
        more.append(overlap(pairs, bag).where(F.col("j") >= similarity).select("u", "v"))

    # large buckets: strangers against the others, block by block
    many = now.where(F.col("size") > small)
    if not many.isEmpty():
        parts = lambda n, held: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(held) / UNITS)).cast("int")
        rows, cols = parts("strangers", "stranger_units"), parts("size", "units")
        at = lambda k, n: F.pmod(F.xxhash64("node", F.lit(k)), n).cast("int")
        one = many.where("outside").select("key", "node", "n", "c", "outside", at(0, rows).alias("i"), F.explode(F.sequence(F.lit(0), cols - 1)).alias("k"), F.lit(0).alias("side"))
        two = many.select("key", "node", "n", "c", "outside", F.explode(F.sequence(F.lit(0), rows - 1)).alias("i"), at(1, cols).alias("k"), F.lit(1).alias("side"))
        payload = bag.join(nodes.select("node", "bands"), "node")
        blocks = one.unionByName(two).join(payload, "node")
        more.append(blocks.groupBy("key", "i", "k").applyInPandas(lambda g: compare_blocks(g, similarity), "u long, v long"))

    if more:
        links = known.where(F.col("j") >= similarity).select("u", "v")
        for m in more:
            links = links.unionByName(m)
        linked = smallest_ids(links)
    return linked


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), kept (doc_id = class_id)."""
    t = id_text(docs)
    signed = materialize(sign(docs, bands, rows), "signatures")
    with_words = signed.where("n > 0")
    groups = with_words.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("doc_id"), F.min("bands").alias("bands"))
    nodes = materialize(groups.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def bag_of(wanted: DataFrame) -> DataFrame:
        ids = nodes.where("doc_id IS NOT NULL").join(wanted, "node", "left_semi").select("doc_id", "node", "k1", "k2")
        may_be = suspect_filter(ids.select(F.col("doc_id").alias("h")))
        texts = t.where("doc_id IS NOT NULL").where(may_be("doc_id"))
        return bags(texts.join(ids, "doc_id").select("node", "k1", "k2", "text")).dropDuplicates(["node"])

    named = nodes.where("doc_id IS NOT NULL")
    linked = linked_nodes(named.select("node", "n", "bands"), bag_of, similarity)
    classes = nodes.select("k1", "k2", "n", "node", F.col("doc_id").alias("class_id"))
    if linked is not None:
        part = classes.join(linked.withColumnRenamed("id", "node"), "node", "left").withColumn("c", F.coalesce("component_id", "node"))
        smallest = part.groupBy("c").agg(F.min("class_id").alias("class_id"))
        classes = part.select("k1", "k2", "n", "c").join(smallest, "c")
    out = with_words.select("doc_id", "k1", "k2", "n").join(classes.select("k1", "k2", "n", "class_id"), ["k1", "k2", "n"]).select("doc_id", "class_id")
    out = out.unionByName(signed.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
