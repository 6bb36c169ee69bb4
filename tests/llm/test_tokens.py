"""Operators 1, 4, 5 and 7 against the public libraries."""

import base64
import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from stratocast.llm import bpe_tree, packing, token_counts, token_store
from stratocast.llm.piece_table import PieceTable
from stratocast.llm.pretoken import split

WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


def random_texts(n, letters, most=30, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("blanks,pattern", [(True, P.PATTERN), (False, WORD_PATTERN)])
def test_boundaries_equal_the_pattern(blanks, pattern):
    texts = random_texts(5000, "a bs'tremvl d12!?\n\t éß  ''xS. ½漢") + ["", "", " ", "'s", "\x00a", "'", "''s", "a's 's"]
    p = split(texts, blanks)
    s = p.strings()
    for i, t in enumerate(texts):
        assert s[p.first[i] : p.first[i + 1]] == regex.findall(pattern, t)


def test_piece_table_survives_being_full():
    table = PieceTable(lambda s: (list(s.encode()), [len(s)]), [np.uint8, np.int32], entries=64)
    texts = random_texts(300, "ab cde", 40, 5) + ["z" * 500, "z" * 500]
    p = split(texts)
    (flat, size), (lengths, one) = table.values(p)
    assert flat.tobytes() == "".join(p.strings()).encode()
    assert lengths.tolist() == [len(s) for s in p.strings()] and (one == 1).all() and size.sum() == len(flat)


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe_tree.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_encoding_equals_library(tik):
    bpe = bpe_tree.model(P.path(bpe_tree.RANKS))
    pieces = random_texts(2000, "abcdeéthion ßrst漢字", 60, 3) + ["a" * k for k in range(1, 300, 7)] + [" " * k for k in range(1, 300, 11)] + ["=-" * 400, "ha" * 3000]
    for x in pieces:
        if x:
            assert bpe.encode_piece(x) == tuple(tik._core_bpe.encode_single_piece(x.encode())), x[:40]
            assert bpe.decode(bpe.encode_piece(x)) == x.encode()


def test_join_is_associative():
    bpe = bpe_tree.model(P.path(bpe_tree.RANKS))
    for a, b, c in zip(*(random_texts(200, "aehinort s", 12, s) for s in (1, 2, 3))):
        x, y, z = (bpe.tree(t.encode()) for t in (a, b, c))
        assert bpe.join(bpe.join(x, y), z) == bpe.join(x, bpe.join(y, z))


def test_op1_rows(make_docs, odd, tik):
    out = bpe_tree.encode(make_docs(odd), ids=True).collect()
    want = []
    for i, t in odd:
        ids = tik.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert any(r["doc_id"] == i and r["ids"] == ids for r in out)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == Counter(want)


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4"))


def test_op5_round_trip(spark, make_docs, odd, byte_level):
    docs = make_docs(odd).repartition(3)
    out = token_store.store_and_read(docs).collect()
    order = sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = {i: [] for i, _ in odd}
    for i, t in order:
        ids[i].append(byte_level.encode(t or "", add_special_tokens=False).ids + [2])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == Counter((i, len(x), crc(x)) for i, xs in ids.items() for x in xs)
    rows = sorted(out, key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [i for i, _ in order]
    assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])[:-1]]).tolist()


def test_store_gives_single_documents(spark, make_docs, odd, byte_level, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write(make_docs(odd * 30), path)
    want = byte_level.encode(odd[4][1], add_special_tokens=False).ids + [2]
    assert token_store.fetch(spark, path, 5) == [want] * 30
    assert token_store.fetch(spark, path, 999) == []


def test_block_checks_its_dictionary():
    data = token_store.pack_block([1], [1], [b""], 2, token_store.dictionary_hash(b"one"))
    with pytest.raises(ValueError):
        token_store.Block(data, b"two")


def test_op7_counts(make_docs, odd):
    t = Tokenizer.from_file(P.path(token_counts.TOKENIZER))
    out = token_counts.count_tokens(make_docs(odd)).collect()
    want = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in odd]
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out) == Counter((*w, w[2] > 2048) for w in want)


def test_op7_counts_of_every_low_character():
    counter = token_counts.WordCounter(P.path(token_counts.TOKENIZER))
    texts = [f"x{chr(c)}Y {chr(c)}{chr(c)}1{chr(c)}" for c in range(1, 0x2100)]
    assert counter.counts(texts) == [len(e.ids) for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)]


# --- packing ---------------------------------------------------------------
def exhaustive(items, capacity):
    """Fewest bins, by trying every bin for every item."""
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in sorted(set(range(len(bins))), key=lambda k: bins[k]):
            if bins[k] + items[i] <= capacity:
                go(i + 1, bins[:k] + [bins[k] + items[i]] + bins[k + 1 :])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def used(plan, count):
    left = count.copy()
    for times, use in plan:
        for l, c in use.items():
            left[l] -= times * c
    return left


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_optimal_on_small_cases(seed):
    rnd = random.Random(seed)
    items = sorted((rnd.randrange(1, 21) for _ in range(rnd.randrange(1, 9))), reverse=True)
    count = np.bincount(items, minlength=21)
    plan = packing.plan_fillings(count, 20)
    assert not used(plan, count).any()
    assert all(sum(l * c for l, c in u.items()) <= 20 for _, u in plan)
    assert sum(t for t, _ in plan) == exhaustive(items, 20)
    assert packing.lower_bound(count, 20) <= exhaustive(items, 20)


def test_dominated_fillings_are_left_out():
    count = np.zeros(2049, np.int64)
    count[[1000, 524, 300, 200, 100]] = [1, 2, 2, 2, 3]
    assert list(packing.fillings(count, 2048, 2048)) == [{1000: 1, 524: 2}]
    assert packing.dominates({1000: 1, 524: 2}, {1000: 1, 524: 1, 300: 1, 200: 1}) and packing.dominates({9: 1, 6: 1}, {9: 1, 3: 1, 2: 1})
    assert not packing.dominates({9: 1, 6: 1}, {9: 1, 5: 1, 2: 1}) and not packing.dominates({9: 1}, {10: 1}) and packing.dominates({7: 2}, {7: 2})
    rnd = random.Random(5)
    for _ in range(200):
        one, other = (Counter(rnd.randrange(1, 9) for _ in range(rnd.randrange(1, 5))) for _ in range(2))
        bins, rest = list(one.elements()), list(other.elements())
        deals = any(all(sum(x for x, k in zip(rest, to) if k == b) <= bins[b] for b in range(len(bins))) for to in itertools.product(range(len(bins)), repeat=len(rest)))
        if packing.dominates(one, other):
            assert deals
        elif not one & other:
            assert not deals  # without documents in common the test is exact


def test_plan_of_many_documents_is_near_the_bound():
    rng = np.random.default_rng(2)
    count = np.bincount(np.clip(rng.lognormal(6, 1, 200_000).astype(int) + 1, 1, 2048), minlength=2049)
    plan = packing.plan_fillings(count, 2048, nodes=3000)
    assert not used(plan, count).any()
    assert sum(t for t, _ in plan) <= 1.002 * packing.lower_bound(count, 2048)
    assert len(plan) <= sum(2048 // l for l in range(1, 2049))


def check_packing(out, docs, byte_level, capacity=2048):
    want = Counter()
    for i, t in docs:
        ids = byte_level.encode(t or "", add_special_tokens=False).ids + [0]
        head = len(ids) % capacity or capacity
        cut = [0, *range(head, len(ids) + 1, capacity)]
        want.update((i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cut, cut[1:])))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_op4_rows(make_docs, odd, byte_level):
    docs = odd + [(100 + i, "short text") for i in range(500)]
    n = check_packing(packing.pack(make_docs(docs)).collect(), docs, byte_level)
    total = sum(len(byte_level.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in docs)
    assert n <= -(-total // 2048) + 1


@pytest.mark.parametrize("op", [bpe_tree.encode, token_store.store_and_read, token_counts.count_tokens, packing.pack])
def test_empty_table(make_docs, op):
    assert op(make_docs([])).collect() == []
