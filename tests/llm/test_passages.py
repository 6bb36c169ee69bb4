"""Operators 12 and 13 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocast.llm import period_runs, super_kmers
from stratocast.llm import words as W
from stratocast.llm.queries import planted_period

WORD = re.compile("[^\x20\x09-\x0d]+")


def words_of(text):
    return WORD.findall(text or "")


# --- operator 12 ------------------------------------------------------------------------


def removed_by_brute_force(rows, window):
    """rows (doc_id, text) -> sorted (doc_id, n_words, n_removed, kept); equal rows are one document."""
    order = lambda r: (r[0] is None, r[0] or 0, hash_of(r[1]))
    seen, gone = {}, {}
    for r in sorted(set(rows), key=order):
        words = words_of(r[1])
        marks = [False] * len(words)
        for i in range(len(words) - window + 1):
            k = tuple(words[i : i + window])
            if k in seen:
                marks[i : i + window] = [True] * window
            seen.setdefault(k, 1)
        gone[r] = marks
    out = []
    for r in rows:
        words = words_of(r[1])
        out.append((r[0], len(words), sum(gone[r]), " ".join(w for w, g in zip(words, gone[r]) if not g)))
    return sorted(out, key=str)


HASHES = {}


def hash_of(text):
    return HASHES[text or ""]


def passage_corpus(seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 5)))
    shared = [[word() for _ in range(rnd.choice([20, 21, 25, 60]))] for _ in range(4)]
    texts = []
    for _ in range(120):
        w = [word() for _ in range(rnd.choice([0, 3, 30, 90]))]
        for _ in range(rnd.choice([0, 1, 1, 3])):
            w += rnd.choice(shared)[rnd.choice([0, 0, 1]) :] + [word() for _ in range(rnd.choice([0, 1, 15]))]
        texts.append(rnd.choice([" ", "\n", "\t\x0b "]).join(w))
    texts += ["spam " * 70, "spam " * 19, "spam " * 21, "a b " * 40, texts[3], texts[3] + " tail", "", None, " \n", "x" * 3000]
    texts += ["no\xa0break " * 30, "a\x1cb\x85c " * 25, " wide " * 22]
    rnd.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(5, texts[5]), (5, texts[6]), (None, texts[8]), (None, texts[9]), (None, texts[9]), (-4, texts[10])]
    return rows


def run_op12(spark, make_docs, rows, **options):
    for r in spark.createDataFrame([(t,) for t in {t or "" for _, t in rows}], "t string").select("t", F.xxhash64("t").alias("h")).collect():
        HASHES[r["t"]] = r["h"]
    out = super_kmers.drop_repeated(make_docs(rows).repartition(5), **options).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out), key=str)


@pytest.mark.parametrize("options", [{}, {"window": 7, "block_bytes": 2000, "bucket_bytes": 1500, "at_once": 300}, {"block_bytes": 1, "bucket_bytes": 1 << 30, "at_once": 1}])
def test_op12_rows(spark, make_docs, options):
    rows = passage_corpus()
    assert run_op12(spark, make_docs, rows, **options) == removed_by_brute_force(rows, options.get("window", 20))


def test_op12_odd_rows(spark, make_docs, odd):
    assert run_op12(spark, make_docs, odd) == removed_by_brute_force(odd, 20)


def test_op12_long_text(spark, make_docs):
    rnd = random.Random(5)
    body = " ".join(f"w{rnd.randrange(50_000)}" for _ in range(300_000))
    rows = [(1, body), (2, "new " + body[100_000:400_000]), (3, "z " * 400_000)]
    assert run_op12(spark, make_docs, rows) == removed_by_brute_force(rows, 20)


def test_op12_a_passage_in_all_rows(spark, make_docs):
    """The passage goes out once a block; windows over its edges spread over buckets, as they rank by their own words."""
    rnd = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"u{rnd.randrange(10**6)}" for _ in range(30)) + " " + passage + " " + " ".join(f"v{rnd.randrange(10**6)}" for _ in range(30))) for i in range(300)]
    assert run_op12(spark, make_docs, rows, bucket_bytes=2000) == removed_by_brute_force(rows, 20)
    texts = [t.encode() for _, t in rows]
    zero = np.zeros(len(rows))
    columns = {"lost": zero.astype(np.uint8), "doc_id": np.arange(len(rows)), "h": np.arange(len(rows))}
    docs = make_docs(rows).select("text")
    common = super_kmers.common_stretches(docs, len(rows))
    assert len(common) == 37

    def most(hot):
        sent = super_kmers.block_messages(columns, texts, 200, hot, 20)
        return max(int(super_kmers.unpacked(part)[0]["count"].sum()) for _, kind, body in sent if kind == 1 for part in super_kmers.opened(body) if part)

    assert most(common) * 3 < most(common[:0])


def test_equal_hashes_of_other_words_are_told_apart():
    t = W.Tokens([b"a b c d a b c x a b c d"])
    at = np.arange(9)
    want = [0, 1, 2, 3, 4, 5, 6, 7, 0]
    assert super_kmers.first_equal(t, at, 4).tolist() == want
    t.h[:] = 0
    assert super_kmers.first_equal(t, at, 4).tolist() == want


def test_tokens_are_the_words():
    rnd = random.Random(9)
    texts = ["".join(rnd.choice([" ", "\n", "\t ", "a", "bc", "\x0b", "\xa0", "é", "\x1c"]) for _ in range(rnd.randrange(12))).encode() for _ in range(300)]
    t = W.Tokens(texts)
    words = [w.encode() for x in texts for w in words_of(x.decode())]
    assert t.count.tolist() == [len(words_of(x.decode())) for x in texts]
    assert [t.buf[a:b].tobytes() for a, b in zip(t.starts, t.ends)] == words
    assert len(set(t.h.tolist())) == len(set(words)) and len(set(zip(t.h.tolist(), words))) == len(set(words))
    assert len(W.Tokens([]).h) == 0 and W.Tokens([b"", b" "]).count.tolist() == [0, 0]


def test_minimiser_is_the_smallest_of_the_window():
    h = np.random.default_rng(1).integers(0, 1 << 63, 200, dtype=np.uint64)
    g = W.mixed(W.rolling(h, 4)) >> np.uint64(1)
    got = super_kmers.minimisers(h, 20, np.zeros(0, np.uint64))
    assert got.tolist() == [int(g[i : i + 17].min()) for i in range(181)]
    common = np.sort(g[::2])
    ranked = [int(x) + (i % 2 == 0) * (1 << 63) for i, x in enumerate(g)]
    assert super_kmers.minimisers(h, 20, common).tolist() == [min(ranked[i : i + 17]) for i in range(181)]


# --- operator 13 ------------------------------------------------------------------------


def runs_by_brute_force(x, least=24):
    out = []
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(least, 3 * q) and not any(all(x[t] == x[t + p] for t in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed_by_brute_force(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_sequence(rnd, upto):
    x, n = [], rnd.randrange(upto)
    while len(x) < n:
        if rnd.random() < 0.6:
            p = [rnd.randrange(rnd.choice([2, 3, 50])) for _ in range(rnd.choice([1, 2, 3, 5, 9, 13, 20]))]
            p *= rnd.randrange(1, 12)
            x += p[: rnd.randrange(1, len(p) + 1)]
        else:
            x += [rnd.randrange(40) for _ in range(rnd.randrange(1, 20))]
    return x


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


@pytest.mark.parametrize("least", [24, 6, 9, 12])
def test_runs_of_sequences(least):
    rnd = random.Random(least)
    for trial in range(60):
        docs = [periodic_sequence(rnd, 250) for _ in range(rnd.randrange(1, 6))]
        if trial % 7 == 0:
            docs += [docs[0], thue_morse(400), [0] * 100, []]
        n = np.array([len(d) for d in docs])
        starts = np.cumsum(n) - n
        ids, doc_of = np.array([w for d in docs for w in d], np.int64), np.repeat(np.arange(len(n)), n)
        want = sorted(((s + a, s + a + l, q) for d, a in zip(docs, starts.tolist()) for s, l, q in runs_by_brute_force(d, least)), key=lambda r: (r[0], r[2]))
        assert list(zip(*(x.tolist() for x in period_runs.runs(ids, doc_of, least)))) == want
        if len(ids):
            g = period_runs.Grammar(ids, doc_of)
            exact = period_runs.merged(*period_runs.derived_runs(g, *period_runs.crossing_runs(ids, g, least, exact=True)))
            assert list(zip(*(x.tolist() for x in exact))) == want


def test_grammar_derives_the_text_and_shares_copies():
    rnd = random.Random(1)
    docs = [periodic_sequence(rnd, 300) for _ in range(6)]
    docs = [d for d in docs if d]
    docs += docs
    n = np.array([len(d) for d in docs])
    g = period_runs.Grammar(np.array([w for d in docs for w in d], np.int64), np.repeat(np.arange(len(n)), n))

    def derived(s):
        return [s] if s < g.terms else derived(g.left[s - g.terms]) + derived(g.right[s - g.terms])

    assert [derived(s) for s in g.roots.tolist()] == docs
    assert g.roots.tolist()[: len(docs) // 2] == g.roots.tolist()[len(docs) // 2 :]
    pairs = list(zip(g.left.tolist(), g.right.tolist()))
    assert len(set(pairs)) > 0.98 * len(pairs)  # a pair left over in one round may be made again in another


def test_a_hash_that_claims_too_much_is_found_out(monkeypatch):
    monkeypatch.setattr(period_runs.W, "mixed", lambda h: np.zeros_like(h))  # any two words agree
    rnd = random.Random(2)
    x = periodic_sequence(rnd, 400) + [7] * 40 + list(range(100))
    got = period_runs.runs(np.array(x), np.zeros(len(x), np.int64))
    assert [(s, e - s, q) for s, e, q in zip(*(c.tolist() for c in got))] == runs_by_brute_force(x)


def expected_op13(doc_id, text):
    words = words_of(text)
    places = planted_period(doc_id, len(words))
    if places is not None:
        words = [words[i] for i in places]
    runs = runs_by_brute_force(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapsed_by_brute_force(words, runs)))


def test_op13_query(spark, make_docs, odd, tmp_path):
    from stratocast.llm.registry import QUERIES

    rnd = random.Random(4)
    rows = [(i, " ".join(f"w{x}" for x in periodic_sequence(rnd, 300))) for i in range(150)]
    rows += [(1000 + i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(200)))) for i in range(150)]
    rows += odd + [(3, "one " * 23), (3, "one " * 24), (3, "a b c d e f g h " * 3), (None, "x y " * 50), (-5, "x\ny\t" * 60)]
    make_docs(rows).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted((tuple(r[c] for c in columns) for r in out), key=str) == sorted((expected_op13(i, t) for i, t in rows), key=str)
    assert sum(planted_period(i, 9) is not None for i, _ in rows) > 10


def test_op13_very_long_texts(make_docs):
    rnd = random.Random(8)
    body = [f"w{rnd.randrange(100_000)}" for _ in range(200_000)]
    rows = [(1, " ".join(body)), (2, "z " * 500_000), (3, " ".join(body[:60_000] * 4))]
    got = {r["doc_id"]: r for r in period_runs.periodic_runs(make_docs(rows)).collect()}
    assert [tuple(x) for x in got[2]["runs"]] == [(0, 500_000, 1)] and got[2]["collapsed"] == "z"
    assert [tuple(x) for x in got[3]["runs"]] == [(0, 240_000, 60_000)] and got[3]["collapsed"] == " ".join(body[:60_000])
    assert got[1]["n_words"] == 200_000 and got[1]["collapsed"] == rows[0][1]


@pytest.mark.parametrize("op", [super_kmers.drop_repeated, period_runs.periodic_runs])
def test_empty_table(make_docs, op):
    assert op(make_docs([])).collect() == []
