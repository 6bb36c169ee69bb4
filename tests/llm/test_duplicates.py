"""Operators 2, 3 and 6 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocast.llm import bag_minhash, cover_tree, exact_dedup, golomb, word_bags
from stratocast.llm.components import smallest_ids


def components(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 50, 5000])
def test_golomb_round_trip(n):
    rng = np.random.default_rng(n)
    for low, high in ((0, 1 << 64), (1 << 63, 1 << 64), (12345, 12345 + max(1, 3 * n))):
        v = np.sort(rng.integers(low, high, n, np.uint64, endpoint=False))
        assert (golomb.decode(golomb.encode(v, low, high), low) == v).all()


def test_golomb_is_small():
    v = np.sort(np.random.default_rng(0).integers(0, 1 << 64, 1 << 16, np.uint64, endpoint=False))
    assert len(golomb.encode(v, 0, 1 << 64)) < len(v) * 51 / 8


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return Counter(out)


def got_exact(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


def test_op2_rows(make_docs, odd):
    rows = odd + [(100 + i, "copy") for i in range(300)] + [(500 + i, f"text {i % 40}") for i in range(200)]
    assert got_exact(exact_dedup.exact_duplicates(make_docs(rows).repartition(7))) == exact(rows)


def test_op2_when_hashes_collide_and_the_bitmap_is_full(make_docs, odd):
    rows = odd + [(100 + i, f"t{i % 30}") for i in range(90)]
    weak = exact_dedup.exact_duplicates(make_docs(rows), fingerprint=lambda t: F.pmod(F.xxhash64(t), F.lit(5)).cast("long"), bits=32)
    assert got_exact(weak) == exact(rows)


def test_op2_blocks_are_bounded(make_docs, monkeypatch, odd):
    monkeypatch.setattr(exact_dedup, "BLOCK_ROWS", 1)  # workers read the module's own value; blocks just stay larger there
    assert got_exact(exact_dedup.exact_duplicates(make_docs(odd))) == exact(odd)


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)] + [(60, 61), (61, 60)], [(9, 3), (3, 7), (8, 9), (20, 21)]])
def test_components(spark, links):
    got = {r["id"]: r["component_id"] for r in smallest_ids(spark.createDataFrame(links, "u long, v long")).collect()}
    want = components(80, links)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: want[i] for i in nodes}


# --- embeddings --------------------------------------------------------------
def clustered(seed=0, dim=16):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(25):
        c = rng.normal(size=dim)
        out += [c + rng.normal(size=dim) * s for s in rng.choice([0.0, 0.02, 0.08, 0.25], rng.integers(1, 25))]
    c = rng.normal(size=dim)
    out += [c * rng.uniform(0.5, 3) for _ in range(60)] + [c + rng.normal(size=dim) * 0.05 for _ in range(60)]
    return [list(map(float, v)) for v in out]


def brute_links(vectors, threshold=0.95):
    n = len(vectors)
    hit = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a and b and len(a) == len(b) and None not in a and None not in b:
                x, y = np.array(a), np.array(b)
                if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any():
                    hit[i, j] = hit[j, i] = x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold
    return hit


@pytest.mark.parametrize("block", [40, 4096])
def test_op3_rows(spark, block):
    vectors = clustered() + [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    df = spark.createDataFrame([(i * 3 + 1, v, 0, "clash") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int, w string").repartition(5)
    vectors = [None if v is None else [None if c is None else float(np.float32(c)) for c in v] for v in vectors]
    hit = brute_links(vectors)
    comp = components(len(vectors), np.argwhere(hit).tolist())
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cover_tree.linked_vectors(df, block_rows=block).collect()}
    assert got == {i * 3 + 1: (int(hit[i].sum()), comp[i] * 3 + 1, comp[i] == i) for i in range(len(vectors))}


def test_levels_are_nested_and_cover():
    x = cover_tree._unit(np.array(clustered(3)))
    l = cover_tree.levels(x)
    for k, r in enumerate(cover_tree.RADII):
        assert (np.linalg.norm(x - x[l[k]], axis=1) <= r + 1e-3).all()
        assert (l[k][l[k]] == l[k]).all()
        if k:
            assert (l[k][l[k - 1]] == l[k - 1]).all() and (l[k - 1][l[k]] == l[k - 1]).all()


def test_op3_empty(spark):
    assert cover_tree.linked_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# --- near duplicates ---------------------------------------------------------
def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def test_bags_equal_counting():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["aa", "b", " ", "  ", "\n", "c d e f g h ", "　", "é"]) for _ in range(rnd.randrange(30))) for _ in range(300)] + ["", "one", "a b c d"]
    keys = word_bags.shingles(texts)
    doc, shingle, times = word_bags.counted(keys)
    for i, t in enumerate(texts):
        assert sorted(times[doc == i].tolist()) == sorted(bag(t).values())
    bags = word_bags.entries(doc, shingle, times, len(texts))
    every = [bag(t) for t in texts]
    for i in range(0, 250, 5):
        assert word_bags.shared(bags[i], bags[i + 1]) == sum((every[i] & every[i + 1]).values())
    left, right = [i for i in range(100) if every[i]], [i for i in range(80, 250) if every[i]]
    for columns in (3, 1 << 12):
        got = word_bags.overlaps([bags[i] for i in left], [bags[i] for i in right], columns)
        assert got.tolist() == [[sum((every[i] & every[j]).values()) for j in right] for i in left]


@pytest.mark.parametrize("small", [16, 1])
def test_op6_many_repeats(make_docs, monkeypatch, small):
    """A shingle may stand hundreds of thousands of times; small and large buckets agree with counting."""
    monkeypatch.setattr(bag_minhash, "SMALL", small)
    monkeypatch.setattr(bag_minhash.linked_nodes, "__defaults__", (0.8, small))
    rest = " ".join(f"w{i}" for i in range(53_000))
    texts = ["spam " * n for n in (70_000, 80_000, 300_000, 330_000)] + ["spam " * 247_000 + rest, "spam " * 247_000 + rest + " more"]
    texts += ["spam " * (66_000 + 40 * i) + f"x{i} y{i} z{i}" for i in range(24)]
    bags = [bag(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(bags[i], bags[j]) >= 0.8]
    comp = components(len(texts), links)
    out = bag_minhash.near_duplicates(make_docs(list(enumerate(texts)))).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == dict(enumerate(comp))
    assert comp[2] == comp[3] != comp[4] == comp[5]


def test_signatures_estimate_weighted_jaccard_without_bias():
    rnd = random.Random(4)
    diff = []
    for _ in range(40):
        base = [rnd.randrange(1 << 40) for _ in range(50)]
        a = [x for x in base for _ in range(rnd.choice([1, 1, 2, 7, 30]))]
        b = [rnd.randrange(1 << 40) if rnd.random() < 0.2 else x for x in a]
        keys = np.concatenate([np.sort(np.array(a, np.uint64)), np.sort(np.array(b, np.uint64)) | np.uint64(1 << 48)])
        s = bag_minhash.signatures(*word_bags.counted(keys), 2, 600)
        j = jaccard(Counter(a), Counter(b))
        diff.append(((s[0] == s[1]).mean() - j) / (j * (1 - j) / 600) ** 0.5)
    assert abs(np.mean(diff)) < 0.6 and 0.6 < np.std(diff) < 1.5


def test_signature_does_not_depend_on_the_batch():
    texts = ["a b c d e f g h", "x", "", "p q r s t u v w " * 40, "one two three four five six"]
    whole = bag_minhash.signatures(*word_bags.counted(word_bags.shingles(texts)), len(texts), 120)
    for i, t in enumerate(texts):
        assert (bag_minhash.signatures(*word_bags.counted(word_bags.shingles([t])), 1, 120)[0] == whole[i]).all()


def near_corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rnd.choice([6, 30, 80, 300]))]
        for _ in range(rnd.randrange(1, 5)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 8])):
                w[rnd.randrange(len(w))] = word()
            texts.append(" ".join(w))
    base = [word() for _ in range(120)]  # a large group, each with one or two words changed
    for _ in range(150):
        w = list(base)
        for _ in range(rnd.choice([1, 2])):
            w[rnd.randrange(len(w))] = word()
        texts.append(" ".join(w))
    passage = [word() for _ in range(60)]  # a passage that many documents share
    texts += [" ".join([word() for _ in range(100)] + passage + [word() for _ in range(100)]) for _ in range(40)]
    texts += ["", None, "one", "one", "two words", "spam " * 500, "spam " * 480, "spam " * 100]
    rnd.shuffle(texts)
    return texts


def test_op6_rows(make_docs):
    texts = near_corpus()
    bags = [bag(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= 0.8]
    comp = components(len(texts), links)
    out = bag_minhash.near_duplicates(make_docs([(10 * i + 3, t) for i, t in enumerate(texts)]).repartition(4)).collect()
    assert {r["doc_id"]: (r["class_id"], r["kept"]) for r in out} == {10 * i + 3: (10 * comp[i] + 3, comp[i] == i) for i in range(len(texts))}
    assert len(out) == len(texts)


def test_op6_odd_rows(make_docs, odd):
    out = bag_minhash.near_duplicates(make_docs(odd)).collect()
    assert len(out) == len(odd)
    classes = {(r["doc_id"], r["class_id"]) for r in out}
    assert (7, 1) in classes and (2, 2) in classes and (3, 3) in classes and (4, 4) in classes and (None, None) in classes


@pytest.mark.parametrize("op", [exact_dedup.exact_duplicates, bag_minhash.near_duplicates])
def test_empty_table(make_docs, op):
    assert op(make_docs([])).collect() == []
