"""Operator 11: hard negatives by lists shared among the anchors of a cluster.

Scores are integer inner products of integer vectors.  An anchor's positives are the
rows of its label with the highest scores; its negatives for a positive are the rows
of other labels with the highest scores from ``low`` percent of the positive's up to it.

* Anchors are clustered by direction (centres from a bounded sample of them).  For an
  anchor u at most t away from its centre c, and a row i at the angle s from c, the score
  is at most |u| |i| cos(max(0, s - t)).  So for each cluster the rows are sorted once by
  |i| cos(max(0, s - t)), t the widest angle of its members, and every member walks that
  list until no later row can reach what it still looks for.
* The stated anchors meet all rows in tiles: a block of anchors (whole clusters as
  far as they fit) with a block of rows, each of bounded size.  A tile returns at most
  ``k`` rows an anchor and positive; the best of all tiles are the answer.
* Positives come first.  Their scores then bound the second walk from below.

Where vectors have little structure the bounds end few walks early; the result is exact
all the same and the work then grows as anchors times rows.

Rows without label or vector, with an empty vector, or with a null or non-finite
component take no part; vectors of different length are not compared.  Equal scores go by smaller
vec_id (null last); a repeated row is another row.  Scores beyond a long count as
its limits.  No anchors or an empty table give an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .registry import bounded_sample, map_arrow, ship

POSITIVES, NEGATIVES, LOW = 5, 5, 80
#: Anchors from which centres are taken, the most centres, and rounds of moving them.
SAMPLE, CENTRES, ROUNDS = 4_000, 256, 8
#: Anchors and rows of a tile at most, and rows from which a tile is split for parallel work.
ANCHORS, ROWS, LEAST_ROWS = 16_384, 65_536, 2_048
#: Scores computed at once.
CELLS = 1 << 21
#: Angles may be off by rounding: bounds keep this much clear.
SLACK = 1e-6
LAST = np.iinfo(np.int64).max


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions (zero vectors stay zero) and lengths."""
    x = x.astype(np.float64)
    length = np.sqrt((x * x).sum(1))
    return x / np.maximum(length, 1e-300)[:, None], length


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0), np.int64)


def centres_of(x: np.ndarray, most: int = CENTRES) -> np.ndarray:
    """Centres of directions by a few rounds of spherical k-means."""
    u = np.unique(_unit(x)[0], axis=0)
    k = min(most, max(1, len(u) // 16))
    c = u[np.random.default_rng(7).choice(len(u), k, replace=False)]
    for _ in range(ROUNDS):
        own = (u @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, u)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-300)[:, None], c)
    return c


class Best:
    """The best k rows of each key so far, by score, then vec_id."""

    def __init__(self, keys: int, k: int):
        self.k = k
        self.least = np.full(keys, -np.inf)  # score of the k-th best, -inf while there are fewer
        self.key, self.score, self.vec, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, key, score, vec, row):
        key, score = np.concatenate([self.key, key]), np.concatenate([self.score, score])
        vec, row = np.concatenate([self.vec, vec]), np.concatenate([self.row, row])
        order = np.lexsort((row, vec, -score, key))
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        stay = rank < self.k
        self.key, order, rank = key[stay], order[stay], rank[stay]
        self.score, self.vec, self.row = score[order], vec[order], row[order]
        full = rank == self.k - 1
        self.least[self.key[full]] = np.nextafter(self.score[full].astype(np.float64), -np.inf)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, in doubles where these hold them; beyond a long they count as its limit."""
    largest = lambda x: int(max(abs(int(x.min())), abs(int(x.max())))) if x.size else 0
    if largest(a) * largest(b) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -LAST, LAST).astype(np.int64)


def walks(anchors: np.ndarray, rows: np.ndarray, centres: np.ndarray, visit, needed):
    """All anchors of a tile walk their clusters' lists.

    ``visit(members, places, scores)`` takes a part of the list; ``needed(members)`` says below which score a member
    needs no more rows.  Returns how many scores were computed."""
    u, size = _unit(anchors)
    v, length = _unit(rows)
    near = u @ centres.T
    cell = near.argmax(1)
    done = 0
    for c in np.unique(cell).tolist():
        members = np.flatnonzero(cell == c)
        wide = float(np.arccos(np.clip(near[members, c], -1, 1)).max())
        angle = np.arccos(np.clip(v @ centres[c], -1, 1))
        bound = length * np.cos(np.maximum(0.0, angle - wide - SLACK)) * (1 + SLACK)
        order = np.argsort(-bound, kind="stable")
        bound = bound[order]
        at, step = 0, 256
        while at < len(order) and len(members):
            members = members[bound[at] * size[members] >= needed(members)]
            if not len(members):
                break
            places = order[at : at + min(step, max(256, CELLS // len(members)))]
            visit(members, places, products(anchors[members], rows[places]))
            done += len(members) * len(places)
            at, step = at + len(places), 2 * step
    return done


def positives_of_tile(a: pd.DataFrame, r: pd.DataFrame, centres: np.ndarray, k: int) -> pd.DataFrame:
    best = Best(len(a), k)
    label, node, vec = r["label"].to_numpy(), r["node"].to_numpy(), r["vec"].to_numpy()
    own, me = a["label"].to_numpy(), a["node"].to_numpy()

    def visit(members, places, scores):
        ok = (own[members][:, None] == label[places][None, :]) & (me[members][:, None] != node[places][None, :])
        ok &= scores >= best.least[members][:, None]
        i, j = np.nonzero(ok)
        best.add(members[i], scores[i, j], vec[places[j]], places[j])

    walks(_matrix(a["x"]), _matrix(r["x"]), centres, visit, lambda m: best.least[m])
    return pd.DataFrame({"anchor": me[best.key], "vec": best.vec, "score": best.score})


def negatives_of_tile(a: pd.DataFrame, r: pd.DataFrame, centres: np.ndarray, k: int, low: int) -> pd.DataFrame:
    slots = max((len(p) for p in a["positives"]), default=0)
    best = Best(len(a) * slots, k)
    label, vec = r["label"].to_numpy(), r["vec"].to_numpy()
    own, me = a["label"].to_numpy(), a["node"].to_numpy()
    score = np.zeros((len(a), slots), np.int64)
    open_ = np.zeros((len(a), slots), bool)
    for i, p in enumerate(a["positives"]):
        score[i, : len(p)] = p
        open_[i, : len(p)] = [x >= 0 for x in p]  # nothing lies between low percent of a negative score and the score
    least = np.array([-(-low * int(x) // 100) for x in score.ravel()], np.int64).reshape(score.shape)  # the smallest score in range
    floor = np.where(open_, np.nextafter(least.astype(np.float64), -np.inf), np.inf)

    def visit(members, places, scores):
        other = own[members][:, None] != label[places][None, :]
        for j in range(slots):
            q = score[members, j][:, None]
            ok = other & open_[members, j][:, None] & (scores <= q) & (scores >= least[members, j][:, None]) & (scores >= best.least[members * slots + j][:, None])
            i, t = np.nonzero(ok)
            best.add(members[i] * slots + j, scores[i, t], vec[places[t]], places[t])

    def needed(members):
        return np.maximum(floor[members], best.least.reshape(-1, slots)[members]).min(1)

    if slots:
        walks(_matrix(a["x"]), _matrix(r["x"]), centres, visit, needed)
    return pd.DataFrame({"anchor": me[best.key // max(1, slots)], "place": (best.key % max(1, slots)).astype(np.int32), "vec": best.vec, "score": best.score})


def _first(df: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("vec"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _of_one_length(rows: DataFrame, n: int, anchors: int, positives: int, negatives: int, low: int, tile: tuple[int, int]) -> DataFrame:
    """rows (node, vec, label, x, is_anchor) of one length -> anchor, p_vec, p_score, rank, vec, score."""
    spark = rows.sparkSession
    sample = bounded_sample(rows.where("is_anchor").select("x"), SAMPLE).toArrow().column("x")
    centres = spark.sparkContext.broadcast(centres_of(np.array(sample.to_pylist(), np.float64)))

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                cell = (_unit(x)[0] @ centres.value.T).argmax(1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "label", "x")), pa.array(cell.astype(np.int32))], ["node", "label", "x", "cell"])

    placed = materialize(map_arrow(rows.where("is_anchor").select("node", "label", "x"), assign, "node long, label long, x array<long>, cell int"), "anchors")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect()  # at most CENTRES rows
    # whole clusters to a block while they fit; a larger one is spread over several
    most_anchors, most_rows = tile
    cells, block, held = [], 0, 0
    for r in sizes:
        if held and held + r["n"] > most_anchors:
            block, held = block + 1, 0
        parts = -(-r["n"] // most_anchors)
        cells.append((r["cell"], block, parts))
        block, held = (block, held + r["n"]) if parts == 1 else (block + parts, 0)
    a_blocks = block + (held > 0)
    cores = spark.sparkContext.defaultParallelism
    r_blocks = max(-(-n // most_rows), min(cores, -(-n // min(LEAST_ROWS, most_rows))))

    named = spark.createDataFrame(cells, "cell int, first int, parts int")
    to_row_blocks = F.explode(F.sequence(F.lit(0), F.lit(r_blocks - 1))).alias("r_block")
    to_anchor_blocks = F.explode(F.sequence(F.lit(0), F.lit(a_blocks - 1))).alias("a_block")
    own_block = (F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int").alias("a_block")
    placed = placed.join(F.broadcast(named), "cell").select("node", "label", "x", own_block)
    listed = rows.select("node", "vec", "label", "x", F.pmod(F.xxhash64("node"), F.lit(r_blocks)).cast("int").alias("r_block"), to_anchor_blocks)

    def tiles(asking: DataFrame, fn, schema: str) -> DataFrame:
        return asking.select("*", to_row_blocks).groupBy("a_block", "r_block").cogroup(listed.groupBy("a_block", "r_block")).applyInPandas(fn, schema)

    def near(a: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return positives_of_tile(a, r, centres.value, positives)

    best = _first(tiles(placed, near, "anchor long, vec long, score long"), ["anchor"], positives)
    best = materialize(best.select("anchor", F.col("rank").alias("place"), F.col("vec").alias("p_vec"), F.col("score").alias("p_score")), "positives")
    # at most `positives` an anchor
    lists = best.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "p_score"))), lambda p: p["p_score"]).alias("positives"))
    asking = placed.join(lists, placed["node"] == lists["anchor"]).drop("anchor")

    def hard(a: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return negatives_of_tile(a, r, centres.value, negatives, low)

    found = _first(tiles(asking, hard, "anchor long, place int, vec long, score long"), ["anchor", "place"], negatives)
    return found.withColumn("place", F.col("place") + 1).join(best, ["anchor", "place"])


def hard_negatives(
    embeddings: DataFrame, is_anchor: Column, label: Column | None = None, scale: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, tile: tuple[int, int] = (ANCHORS, ROWS), id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` and ``label`` are expressions over the table's columns; components are scaled and rounded down."""
    spark = embeddings.sparkSession
    ship(spark)
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(v, lambda c: F.floor(c * scale).cast("long"))
    rows = embeddings.select(
        F.col(id_col).cast("long").alias("vec_id"), (label if label is not None else F.col("label")).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
        F.when(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(False)), x).alias("x"),
    ).where("label IS NOT NULL AND x IS NOT NULL")
    rows = rows.select(F.monotonically_increasing_id().alias("node"), "vec_id", F.coalesce("vec_id", F.lit(LAST)).alias("vec"), "label", "is_anchor", "x", F.size("x").alias("dim"))
    rows = materialize(rows, "vectors")
    out = None
    for d in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("anchors")).where("anchors > 0").collect():
        part = _of_one_length(rows.where(F.col("dim") == d["dim"]), d["n"], d["anchors"], positives, negatives, low, tile)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    ids = rows.where("is_anchor").select(F.col("node").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    known = lambda c: F.when(F.col(c) < LAST, F.col(c))
    return out.join(ids, "anchor").select("anchor_id", known("p_vec").alias("positive_id"), "rank", known("vec").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score"))
