"""Operator 11 against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocast.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, node long, x string, rank int, a_block int, score long"


def table(spark, rows):
    return spark.createDataFrame([(i, e, l, 1, "x", 2, 3, 4) for i, e, l in rows], SCHEMA)


TOP = (1 << 63) - 1


def brute_force(rows, is_anchor, k=5, m=5, low=80):
    usable = []
    for n, (i, e, l) in enumerate(rows):
        if l is not None and e and all(c is not None and math.isfinite(c) for c in e):
            usable.append((n, i, l, [math.floor(256 * float(np.float32(c))) for c in e]))
    out = []
    order = lambda s, i: (-s, i is None, i or 0)
    for n, i, l, x in usable:
        if not is_anchor(i):
            continue
        scored = [(max(-TOP, min(TOP, sum(a * b for a, b in zip(x, y)))), j, o) for t, j, o, y in usable if t != n and len(y) == len(x)]
        for p_score, p, _ in sorted((r for r in scored if r[2] == l), key=lambda r: order(r[0], r[1]))[:k]:
            hard = [r for r in scored if r[2] != l and low * p_score <= 100 * r[0] <= 100 * p_score]
            for rank, (s, j, _) in enumerate(sorted(hard, key=lambda r: order(r[0], r[1]))[:m], 1):
                out.append((i, p, rank, j, p_score, s))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()), key=str)


def vectors(seed, n, dim=8, labels=3):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, dim))
    rows = []
    for i in range(n):
        x = centres[rnd.integers(6)] + rnd.normal(size=dim) * rnd.choice([0.05, 0.4])
        rows.append((i, [float(np.float32(c)) for c in x / np.linalg.norm(x)], int(rnd.integers(labels))))
    return rows


@pytest.mark.parametrize("tile", [(H.ANCHORS, H.ROWS), (7, 40)])
def test_op11_rows(spark, tile):
    rows = vectors(1, 400) + vectors(2, 60)  # ids stand twice
    out = H.hard_negatives(table(spark, rows).repartition(3), F.col("vec_id") % 10 == 0, tile=tile)
    want = brute_force(rows, lambda i: i % 10 == 0)
    assert got(out) == want and len(want) > 500


def test_op11_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    one = [0.5, 0.25, -0.125]
    rows = [
        (0, one, 1), (1, one, 1), (2, one, 2), (2, one, 2), (3, [0.45, 0.25, -0.1], 2), (4, None, 1), (5, [], 1), (6, [0.5, None, 0.0], 2), (7, [nan, 0.0, 0.0], 1),
        (8, [inf, 0.0, 0.0], 1), (9, one, None), (10, [0.0, 0.0, 0.0], 1), (20, [0.0, 0.0, 0.0], 2), (30, [-0.5, -0.25, 0.125], 2), (40, [1.0, 1.0], 1), (41, [1.0, 1.0], 1),
        (42, [1.0, 0.9], 2), (None, one, 1), (None, one, 2), (50, [1e9, -2.0, 3.0], 1), (51, [1e9, 5.0, 3.0], 1), (52, [0.9e9, 5.0, 3.0], 3), (60, [-1e9, 2.0, 1.0], 4),
        (70, [1e6, -2.0, 3.0], 5), (71, [1e6, 5.0, 3.0], 5), (72, [0.9e6, 5.0, 3.0], 3), (73, [0.9e6, 5.25, 3.0], 3),
    ]
    out = H.hard_negatives(table(spark, rows).repartition(3), F.col("vec_id") % 10 == 0)
    want = brute_force(rows, lambda i: i is not None and i % 10 == 0)
    assert got(out) == want and want


def test_empty_table_and_no_anchors(spark):
    assert got(H.hard_negatives(table(spark, []), F.col("vec_id") % 10 == 0)) == []
    assert got(H.hard_negatives(table(spark, [(1, [1.0], 1), (None, [1.0], 1)]), F.col("vec_id") % 10 == 0)) == []


def test_walks_end_early_where_vectors_cluster():
    """With tight clusters most of the list is never scored, and the best rows are still exact."""
    rnd = random.Random(3)
    gen = np.random.default_rng(3)
    centres = gen.normal(size=(40, 16))
    x = np.floor(256 * np.concatenate([c / np.linalg.norm(c) + gen.normal(size=(200, 16)) * 0.01 for c in centres])).astype(np.int64)
    anchors = x[[rnd.randrange(len(x)) for _ in range(50)]]
    best = H.Best(len(anchors), 5)

    def visit(members, places, scores):
        i, j = np.nonzero(scores >= best.least[members][:, None])
        best.add(members[i], scores[i, j], places[j], places[j])

    done = H.walks(anchors, x, H.centres_of(x[::7]), visit, lambda m: best.least[m])
    assert done < 0.5 * len(anchors) * len(x)
    s = anchors @ x.T
    for k in range(len(anchors)):
        want = sorted(range(len(x)), key=lambda j: (-s[k, j], j))[:5]
        assert best.row[best.key == k].tolist() == want
