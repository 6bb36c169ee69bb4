"""Operator 3: exact threshold pairs of embeddings by cover-tree dual traversal.

On unit vectors a cosine of c is a Euclidean distance of sqrt(2 - 2c), a metric.

* Top of the tree: centres of radius 1 from a bounded sample.  Every vector goes
  to its nearest centre, whose covering radius is then the largest distance of
  one of its vectors.  Cells are gathered in tree order into blocks of bounded
  size; a cell with more vectors than that is spread over several blocks.
* Each block gets nested levels with halving radii (1, 1/2, 1/4): a centre stays
  a centre below, other vectors belong to the centre that covers them.
* Pairs of cells, then of blocks, then of nodes within two blocks are dropped if
  the distance of their centres exceeds the sum of their covering radii and the
  threshold's distance.  Vectors that are nodes of their own are first bounded in
  the projection on a few main directions (a distance there is never larger).
  What is left is compared vector by vector in double precision, in matrix
  products of bounded size.

A pair of blocks returns, for each vector, how many it links with, and for each
connected set of vectors a star of links - not the pairs, whose number grows
with the square of a group of copies.  Equal vectors are one node with a count.

In high dimensions with little structure few pairs of cells can be dropped (the
covering radii are as large as the distances); the result stays exact and the
work then grows as that of comparing all centres.

Null, empty, zero vectors and those with null or non-finite components link with
nothing; vectors of different length don't link.  Repeated rows count each.  An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import smallest_ids
from .registry import map_arrow, ship

THRESHOLD = 0.95
#: Vectors from which the top centres are taken, and the most such centres.
SAMPLE, CENTRES = 4_000, 256
#: Vectors of a block at most.
BLOCK = 4_096
RADII = (1.0, 0.5, 0.25)
#: Distances that may be off by rounding: bounds keep this much clear.
SLACK = 1e-4
#: Directions in which vectors are compared first.
AXES = 16
#: Entries of a matrix of similarities at once.
CELLS = 1 << 22


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def _vectors(column) -> np.ndarray:
    """A list column without nulls, all of one length, as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def greedy_centres(x: np.ndarray, radius: float, most: int | None = None) -> np.ndarray:
    """Indices of centres, each farther than ``radius`` from those before it; vectors in given order."""
    free = np.ones(len(x), bool)
    out = []
    for i in range(len(x)):
        if free[i]:
            out.append(i)
            if len(out) == most:
                break
            free &= _distance(x @ x[i]) > radius
    return np.array(out, np.int64)


def levels(x: np.ndarray, radii=RADII) -> np.ndarray:
    """For each radius (rows) the centre each vector belongs to; centres of a level are centres below it."""
    out, up = [], np.zeros(len(x), np.int64)
    d = _distance((x @ x.T).astype(np.float32)) if len(x) else np.zeros((0, 0))
    for r in radii:
        mine = np.full(len(x), -1)
        # centres of the level above come first, so that levels are nested
        for i in [*dict.fromkeys(up.tolist()), *range(len(x))] if out else range(len(x)):
            if mine[i] < 0 and (not out or up[i] >= 0):
                near = (mine < 0) & (d[i] <= r)
                if out:
                    near &= up == up[i]
                near[i] = True
                mine[near] = i
        out.append(mine)
        up = mine
    return np.array(out)


def upper_bounds(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Rows whose inner products bound the cosines of x from above: coordinates on a
    few orthonormal axes, and the length of what they leave out."""
    head = x @ axes
    rest = np.sqrt(np.maximum(0.0, 1.0 - (head * head).sum(1, keepdims=True)))
    return np.concatenate([head, rest], 1).astype(np.float32)


class Side:
    """One block: unit vectors, centres by level, and how many vectors each stands for."""

    def __init__(self, x: np.ndarray, l: np.ndarray, w: np.ndarray, axes: np.ndarray):
        self.x, self.l, self.w = x, l, w
        self.bound = upper_bounds(x, axes) if len(x) else np.zeros((0, axes.shape[1] + 1), np.float32)
        self.links = np.zeros(len(x), np.int64)

    def nodes(self, level: int, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """Of the vectors a: those alone in their node; centres, covering radii and members of the other nodes."""
        own = self.l[level][a]
        order = np.argsort(own, kind="stable")
        centres, first, size = np.unique(own[order], return_index=True, return_counts=True)
        d = _distance(np.einsum("ij,ij->i", self.x[a], self.x[own]))[order]
        radius = np.maximum.reduceat(d, first) if len(first) else d
        fat = size > 1
        members = a[order]
        return members[first[~fat]], centres[fat], radius[fat], [members[f : f + n] for f, n in zip(first[fat], size[fat])]


def traverse(left: Side, right: Side, threshold: float) -> np.ndarray:
    """Count the links between two blocks (or within one: the same object) on both
    sides, weighted; return for every vector (left, then right) the first of those connected with it."""
    same = left is right
    tau = math.sqrt(2 - 2 * threshold)
    off = 0 if same else len(left.x)
    parent = list(range(len(left.x) + (0 if same else len(right.x))))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def connect(a, b):
        for i, j in zip(a.tolist(), (b + off).tolist()):
            i, j = find(i), find(j)
            if i != j:
                parent[max(i, j)] = min(i, j)

    def compare(a, b, twice):
        """All vectors a against all of b; twice: the pair of nodes stands for (b, a) as well."""
        step = max(1, CELLS // max(1, len(b)))
        for s in range(0, len(a), step):
            part = a[s : s + step]
            hit = left.x[part] @ right.x[b].T >= threshold
            if same:
                hit &= part[:, None] != b[None, :]
            if not hit.any():
                continue
            np.add.at(left.links, part, hit @ right.w[b])
            if twice:
                np.add.at(right.links, b, left.w[part] @ hit)
            rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
            connect(part[rows], b[hit[rows].argmax(1)])  # each row with its first partner
            connect(part[hit[:, cols].argmax(0)], b[cols])  # each column with its first
            of_a = np.array([find(i) for i in part[rows].tolist()])
            of_b = np.array([find(j) for j in (b[cols] + off).tolist()])
            r, c = np.nonzero(hit[np.ix_(rows, cols)] & (of_a[:, None] != of_b[None, :]))
            connect(part[rows[r]], b[cols[c]])  # what these two stars have not yet connected

    def singles(a, b, mirrored):
        """Vectors that are nodes of their own: candidates by the bound, then in double precision."""
        step = max(1, CELLS // max(1, len(b)))
        for s in range(0, len(a), step):
            part = a[s : s + step]
            near = left.bound[part] @ right.bound[b].T >= np.float32(threshold - SLACK)
            p, q = np.nonzero(near)
            p, q = part[p], b[q]
            if mirrored:
                p, q = p[p < q], q[p < q]
            for t in range(0, len(p), 1 << 16):
                i, j = p[t : t + (1 << 16)], q[t : t + (1 << 16)]
                ok = np.einsum("ij,ij->i", left.x[i], right.x[j]) >= threshold
                i, j = i[ok], j[ok]
                np.add.at(left.links, i, right.w[j])
                np.add.at(right.links, j, left.w[i])
                connect(i, j)

    def go(level, a, b, mirrored):
        """Vectors a and b of one node each (mirrored: of the same)."""
        if level == len(RADII) or len(a) * len(b) <= 1 << 14:
            compare(a, b, not mirrored)
            return
        sa, ca, ra, ma = left.nodes(level, a)
        sb, cb, rb, mb = (sa, ca, ra, ma) if mirrored else right.nodes(level, b)
        singles(sa, sb, mirrored)

        def near(one, r, other, q, vectors):
            """Pairs of centres nearer than their covering radii and the threshold allow."""
            reach = np.minimum(r[:, None] + q[None, :] + tau + SLACK, 2.0)
            return one.x[vectors[0]] @ other.x[vectors[1]].T >= 1 - 0.5 * reach**2 - SLACK

        none_a, none_b = np.zeros(len(sa)), np.zeros(len(sb))
        if len(ca):
            alone, fat = near(left, ra, right, none_b, (ca, sb)), near(left, ra, right, rb, (ca, cb))
            for k in range(len(ca)):
                others = [sb[alone[k]], *(mb[m] for m in np.flatnonzero(fat[k]).tolist() if not mirrored or m > k)]
                others = np.concatenate(others)
                if len(others):
                    go(level + 1, ma[k], others, False)
                if mirrored:
                    go(level + 1, ma[k], ma[k], True)
        if len(cb) and not mirrored:
            alone = near(right, rb, left, none_a, (cb, sa))
            for m in range(len(cb)):
                if alone[m].any():
                    go(level + 1, sa[alone[m]], mb[m], False)

    if len(left.x) and len(right.x):
        go(0, np.arange(len(left.x)), np.arange(len(right.x)), same)
    return np.array([find(i) for i in range(len(parent))])


def _clean(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x (array<double> or null if the vector can't link)."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(False)) & F.exists(v, lambda c: c != 0)
    return embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, v).alias("x"))


def _links_of_one_length(nodes: DataFrame, threshold: float, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """nodes (node, x, w) -> links within (node, links) and stars (u, v)."""
    spark = nodes.sparkSession
    sc = spark.sparkContext
    sample = _vectors(nodes.select("x").limit(SAMPLE).toArrow().column("x").combine_chunks())
    centres = _unit(sample)[greedy_centres(_unit(sample), RADII[0], CENTRES)]
    # tree order: each next centre is the one nearest to the last
    order, left = [0], set(range(1, len(centres)))
    while left:
        nxt = max(left, key=lambda k: (centres[order[-1]] @ centres[k], -k))
        order.append(nxt)
        left.remove(nxt)
    shared = sc.broadcast(centres[order])
    # the sample's main directions: most of a cosine shows in them
    main = sc.broadcast(np.linalg.svd(_unit(sample), full_matrices=False)[2][:AXES].T.copy())

    def assign(batches):
        c = shared.value
        for batch in batches:
            if batch.num_rows:
                cosine = _unit(_vectors(batch.column("x"))) @ c.T
                cell = cosine.argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), batch.column("x"), batch.column("w"), pa.array(cell.astype(np.int32)), pa.array(_distance(cosine[np.arange(len(cell)), cell]))],
                    ["node", "x", "w", "cell", "d"],
                )

    placed = materialize(map_arrow(nodes.select("node", "x", "w"), assign, "node long, x array<double>, w long, cell int, d double"), "cells")
    stats = {r["cell"]: (r["n"], r["r"]) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("r")).collect()}
    total = sum(n for n, _ in stats.values())
    size = min(block_rows, max(256, -(-total // 16)))

    # groups of cells in tree order; a large cell is a group of several blocks
    groups: list[tuple[list[int], int]] = []
    held: list[int] = []
    for cell in sorted(stats):
        if held and sum(stats[c][0] for c in held) + stats[cell][0] > size:
            groups.append((held, 1))
            held = []
        if stats[cell][0] > size:
            groups.append(([cell], -(-stats[cell][0] // size)))
        else:
            held.append(cell)
    if held:
        groups.append((held, 1))
    tau = math.sqrt(2 - 2 * threshold) + SLACK
    between = _distance(shared.value @ shared.value.T)

    def apart(a, b):
        return all(between[c, e] > stats[c][1] + stats[e][1] + tau for c in a for e in b if c != e) and not set(a) & set(b)

    rows = [(g, h, groups[g][1], groups[h][1]) for g in range(len(groups)) for h in range(g, len(groups)) if not apart(groups[g][0], groups[h][0])]
    cells = spark.createDataFrame([(c, g, groups[g][1]) for g in range(len(groups)) for c in groups[g][0]], "cell int, g int, parts int")
    placed = placed.join(F.broadcast(cells), "cell").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # bounded by the number of top centres: at most CENTRES ** 2 / 2 rows
    pairs = spark.createDataFrame(rows, "g int, h int, gn int, hn int")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", ignore_index=True)
        l = levels(_unit(np.stack(group["x"].to_numpy())))
        return pd.DataFrame({"node": group["node"], "x": group["x"], "w": group["w"], "g": group["g"], "part": group["part"], **{f"l{k}": group["node"].to_numpy()[l[k]] for k in range(len(RADII))}})

    columns = "node long, x array<double>, w long, g int, part int, l0 long, l1 long, l2 long"
    blocks = materialize(placed.groupBy("g", "part").applyInPandas(build, columns), "cover-tree-blocks")

    # every block once for each pair of blocks it takes part in
    first = blocks.join(F.broadcast(pairs), "g").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("hn") - 1)))
    first = first.where("g <> h OR part <= other").select("node", "x", "w", "l0", "l1", "l2", F.col("g").alias("g1"), F.col("part").alias("p1"), F.col("h").alias("g2"), F.col("other").alias("p2"), F.lit(0).alias("side"))
    second = blocks.withColumnRenamed("g", "h").join(F.broadcast(pairs), "h").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("gn") - 1)))
    second = second.where("g <> h OR other < part").select("node", "x", "w", "l0", "l1", "l2", F.col("g").alias("g1"), F.col("other").alias("p1"), F.col("h").alias("g2"), F.col("part").alias("p2"), F.lit(1).alias("side"))

    def dual(group: pd.DataFrame) -> pd.DataFrame:
        sides, names = [], []
        for s in (0, 1):
            part = group[group["side"] == s].sort_values("node", ignore_index=True)
            ids = part["node"].to_numpy()
            l = np.array([np.searchsorted(ids, part[f"l{k}"].to_numpy()) for k in range(len(RADII))])
            x = _unit(np.stack(part["x"].to_numpy())) if len(part) else np.zeros((0, main.value.shape[0]))
            sides.append(Side(x, l, part["w"].to_numpy(), main.value))
            names.append(ids)
        one, two = sides
        key = group.iloc[0]
        if key["g1"] == key["g2"] and key["p1"] == key["p2"]:
            root = traverse(one, one, threshold)
            ids, n = names[0], one.links
        else:
            root = traverse(one, two, threshold)
            ids, n = np.concatenate(names), np.concatenate([one.links, two.links])
        on = n > 0
        return pd.DataFrame({"node": ids[on], "root": ids[root[on]], "links": n[on]})

    found = first.unionByName(second).groupBy("g1", "p1", "g2", "p2").applyInPandas(dual, "node long, root long, links long")
    found = materialize(found, "links-of-blocks")
    return found.groupBy("node").agg(F.sum("links").alias("links")), found.select(F.col("root").alias("u"), F.col("node").alias("v"))


def linked_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    ship(embeddings.sparkSession)
    rows = _clean(embeddings, id_col, vector_col).withColumn("k1", F.xxhash64("x")).withColumn("k2", F.xxhash64(F.lit(1), "x"))
    usable = rows.where(F.col("x").isNotNull())
    grouped = usable.groupBy("k1", "k2").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("w"), F.min("x").alias("x"))
    nodes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("x")), "vectors")

    counts = stars = None
    for r in nodes.select("dim").distinct().collect():  # vectors of one length each
        n, s = _links_of_one_length(nodes.where(F.col("dim") == r["dim"]), threshold, block_rows)
        counts = n if counts is None else counts.unionByName(n)
        stars = s if stars is None else stars.unionByName(s)
    alone = rows.where(F.col("x").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if counts is None:
        out = alone
    else:
        names = smallest_ids(stars).withColumnRenamed("id", "node").withColumnRenamed("component_id", "c")
        full = nodes.select("node", "k1", "k2", "vec_id", "w").join(counts, "node", "left").join(names, "node", "left")
        full = full.select("k1", "k2", "vec_id", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("c", "node").alias("c"))
        smallest = full.groupBy("c").agg(F.min("vec_id").alias("component_id"))
        full = full.select("k1", "k2", "n_links", "c").join(smallest, "c").drop("c")
        out = usable.select("vec_id", "k1", "k2").join(full, ["k1", "k2"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
