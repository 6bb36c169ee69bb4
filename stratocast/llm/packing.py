"""Operator 4: packing of documents into sequences by bin completion.

Each document's ids (plus an end id) are cut into pieces of at most ``CAPACITY``
tokens; only the first piece of a longer document may be shorter than that.  How
pieces fill sequences depends on their lengths alone, and there are at most
``CAPACITY`` different lengths, so the search runs on the histogram of lengths
(a few KB on the driver, however many documents there are):

* a filling is planned around the largest remaining length.  Its candidates take
  each available second length, the one that promises least waste first, and go on
  with the longest that fits.  A candidate is left out if another one of the node
  dominates it in Martello and Toth's sense: the documents of the one can be dealt to
  those of the other as to bins (tested up to ``DEALT`` documents, and up to ``STEPS``
  steps; what is not decided stays);
* a filling is used as often as the counts allow, then half as often, down to once, so a
  search of a few thousand steps packs any number of documents;
* best-fit decreasing gives the first incumbent; branches whose waste so far
  rules out fewer sequences than the incumbent's are cut; the search goes on depth first,
  candidates being made as they are asked for, and ends at the lower bound (Martello and
  Toth's L2), when nothing is left, or after ``NODES`` nodes - then with the incumbent.

Each filling of best fit empties some length or leaves fewer of it than one filling
takes, so that plan has at most sum(CAPACITY / l) fillings, and one that the search finds
at most ``NODES``: its size is bounded whatever the input.  On Spark every piece gets its rank among pieces of its length
(counts by (length, salt) first, so no length is ever one task) and finds its
sequence and offset in the broadcast plan by binary search.

Defined cases: null text: empty, one piece with the end id; an empty table gives
an empty result; repeated rows are packed each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .library_pieces import encoder
from .registry import id_text, map_arrow

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
CAPACITY = 2048
#: Nodes of the search.
NODES = 6_000
#: Documents of a filling up to which, and steps within which, it is decided whether it is dominated.
DEALT, STEPS = 16, 2_000
#: Pieces of one (length, salt) group on average, if all had one length.
GROUP = 20_000

Filling = tuple[int, dict[int, int]]  # times used, {length: documents of it}


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2 on a histogram (count[l] items of length l)."""
    l = np.arange(capacity + 1)
    n, s = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * l)])
    best = -(-int((count * l).sum()) // capacity)
    half = capacity // 2
    for a in range(half + 1):
        high, mid = int(n[-1] - n[capacity - a + 1]), int(n[capacity - a + 1] - n[half + 1])
        room = mid * capacity - int(s[capacity - a + 1] - s[half + 1])
        low = int(s[half + 1] - s[a])
        best = max(best, high + mid + max(0, -(-(low - room) // capacity)))
    return best


def _fit(count: np.ndarray, first: int, capacity: int, second: int = 0) -> dict[int, int]:
    """Best fit around ``first`` (and ``second``): always the longest document that still fits."""
    use, gap = {first: 1}, capacity - first
    if second:
        use[second] = use.get(second, 0) + 1
        gap -= second
    while gap > 0:
        free = count[: gap + 1].copy()
        for l, c in use.items():
            if l <= gap:
                free[l] -= c
        there = np.flatnonzero(free > 0)
        if not len(there):
            break
        l = int(there[-1])
        c = min(int(free[l]), gap // l)
        use[l] = use.get(l, 0) + c
        gap -= c * l
    return use


def dominates(one: dict[int, int], other: dict[int, int]) -> bool:
    """Whether the documents of ``other`` can be dealt to those of ``one`` as to bins (so ``one`` leaves no worse a rest)."""
    bins = sorted((l for l, c in one.items() for _ in range(max(0, c - other.get(l, 0)))), reverse=True)
    rest = sorted((l for l, c in other.items() for _ in range(max(0, c - one.get(l, 0)))), reverse=True)
    if sum(rest) > sum(bins) or len(rest) > DEALT:
        return False
    steps = STEPS

    def deal(i: int) -> bool:
        nonlocal steps
        if i == len(rest):
            return True
        tried = set()
        for k, room in enumerate(bins):
            if room >= rest[i] and room not in tried and steps > 0:
                steps -= 1
                tried.add(room)
                bins[k] -= rest[i]
                if deal(i + 1):
                    return True
                bins[k] += rest[i]
        return False

    return deal(0)


def fillings(count: np.ndarray, capacity: int, waste: int) -> Iterator[dict[int, int]]:
    """Undominated fillings around the largest length with at most this waste, made as they are asked for."""
    first = int(np.flatnonzero(count)[-1])
    gap = capacity - first
    left = count[: gap + 1].copy()
    if first <= gap:
        left[first] -= 1
    there = np.flatnonzero(left > 0)
    if not len(there):
        if gap <= waste:
            yield {first: 1}
        return
    # what each second length would leave if no document ran out
    longest = np.maximum.accumulate(np.where(left > 0, np.arange(gap + 1), 0))
    rest, size = gap - there, np.ones(len(there), np.int64)
    while (nxt := longest[rest]).any():
        rest, size = rest - nxt, size + (nxt > 0)
    made: list[dict[int, int]] = []
    for second in there[np.lexsort((-there, size, rest))].tolist():
        use = _fit(count, first, capacity, second)
        if capacity - sum(l * c for l, c in use.items()) <= waste and not any(dominates(u, use) for u in made):
            made.append(use)
            yield use


def best_fit(count: np.ndarray, capacity: int) -> list[Filling]:
    count, plan = count.copy(), []
    while count.any():
        use = _fit(count, int(np.flatnonzero(count)[-1]), capacity)
        times = min(int(count[l]) // c for l, c in use.items())
        for l, c in use.items():
            count[l] -= times * c
        plan.append((times, use))
    return plan


def plan_fillings(count: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[Filling]:
    """Fillings that use up the histogram in as few sequences as the search finds."""
    count = count.astype(np.int64)
    total = int((count * np.arange(capacity + 1)).sum())
    bound = lower_bound(count, capacity)
    best = best_fit(count, capacity)
    n_best = sum(t for t, _ in best)

    def branches(left: np.ndarray, waste: int) -> Iterator[tuple[int, dict[int, int]]]:
        for use in fillings(left, capacity, waste):
            times = min(int(left[l]) // c for l, c in use.items())
            while times:
                yield times, use
                times //= 2

    def allowed(waste: int) -> int:
        return (n_best - 1) * capacity - total - waste

    # counts left, chain of fillings, sequences, waste, what may come next
    stack = [(count, None, 0, 0, branches(count, allowed(0)))]
    while stack and nodes > 0 and n_best > bound:
        left, chain, used, waste, more = stack[-1]
        if not left.any():
            best, n_best = [], used
            while chain:
                best.append(chain[0])
                chain = chain[1]
        step = next(more, None) if left.any() and allowed(waste) >= 0 else None
        if step is None:
            stack.pop()
            continue
        nodes -= 1
        times, use = step
        after = left.copy()
        for l, c in use.items():
            after[l] -= times * c
        lost = waste + times * (capacity - sum(l * c for l, c in use.items()))
        stack.append((after, (step, chain), used + times, lost, branches(after, allowed(lost)) if after.any() else iter(())))
    return best


def segments(plan: list[Filling]) -> np.ndarray:
    """Rows (length, first rank, documents of it in a filling, first sequence, first offset), by length and rank."""
    rows, rank, seq = [], {}, 0
    for times, use in plan:
        offset = 0
        for l, c in sorted(use.items(), reverse=True):
            rows.append((l, rank.get(l, 0), c, seq, offset))
            rank[l] = rank.get(l, 0) + times * c
            offset += l * c
        seq += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of every document."""

    def run(batches):
        e = encoder(tokenizer)
        for batch in batches:
            out = []
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), e.encode(batch.column("text").to_pylist())):
                ids = np.append(x, end_id).astype("<u4")
                cut = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                out += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return map_arrow(id_text(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Columns: those of ``pieces``, sequence_id, offset."""
    cut = materialize(pieces(docs, tokenizer, end_id, capacity), "pieces")
    histogram = cut.groupBy("length").count().collect()  # at most ``capacity`` rows
    count = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        count[r["length"]] = r["count"]
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(segments(plan_fillings(count, capacity)))

    salts = max(8, int(count.sum()) // GROUP)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sums = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    by_length = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("length", "salt", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("before"))
    in_group = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(in_group) - 1).drop("salt", "before")

    def run(batches):
        plan = table.value
        key = (plan[:, 0] << 44) + plan[:, 1]
        for batch in batches:
            l, r = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            s = plan[np.searchsorted(key, (l << 44) + r, side="right") - 1]
            turn = r - s[:, 1]
            columns = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            columns["sequence_id"] = pa.array(s[:, 3] + turn // s[:, 2])
            columns["offset"] = pa.array(s[:, 4] + turn % s[:, 2] * l)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
