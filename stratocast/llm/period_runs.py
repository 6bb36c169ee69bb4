"""Operator 13: periodic runs of words, found on a grammar of the text.

1. Re-Pair over the word numbers of a chunk of documents, in rounds: in each round
   neighbours are paired where their pair is locally the most frequent one (by
   power-of-two class of its count, then by a fixed scrambling), and each distinct
   pair becomes one nonterminal (one that is left over somewhere may become another one
   in a later round).  A run of one symbol is paired off from its start.  Pairs never
   cross documents; rounds go on until every document is one symbol.  Copies and repeats
   thus share nonterminals.
2. Every run lies in the smallest nonterminal that contains it, across the boundary of
   its two parts.  So each nonterminal is searched once, at one of its occurrences: a
   run of period q and at least ``min_length`` words has words on one side that recur
   q further, so q is the distance to another occurrence of the few words at the
   boundary.  Those distances are tried, and what holds is extended both ways.  Of
   equal stretches the smallest period counts.
3. From the documents' symbols down, runs are carried to all positions at which
   their nonterminal is derived; branches without runs are not followed.
4. Stretches of one period that share a period's length are one: the maximal runs.

Extents come from prefix hashes by bisection and are then compared word by word; if a
hash ever claimed too much, the chunk is done again with exact ranks of stretches.

Null text counts as empty: no words, no runs, an empty collapsed text.  Rows are
independent: repeated rows, ties of doc_id and null ids each get their own result, an
empty table an empty one; other columns are ignored.  A text is held whole by one task
with some 300 bytes per word.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .registry import id_text, map_arrow, text_chunks

MIN_LENGTH, MIN_PERIODS = 24, 3
#: Characters of a chunk of documents that share a grammar (a longer text stands alone).
CHUNK = 1 << 20
#: Distances tried at once.
TRIED = 1 << 21


class Grammar:
    """Symbols 0..terms-1 are words; rule k is symbol terms+k.  ``at`` is one place where the rule occurs."""

    def __init__(self, ids: np.ndarray, doc_of: np.ndarray):
        terms = int(ids.max()) + 1 if len(ids) else 0
        left, right, at, size = [], [], [], [np.ones(terms, np.int64)]
        self.terms, self.first = terms, [terms]
        s, d, p = ids, doc_of, np.arange(len(ids))
        length = np.ones(len(ids), np.int64)
        while len(s) > 1 and (inside := d[1:] == d[:-1]).any():
            chosen, of = self._choose(s, inside, self.first[-1])
            kinds, where, which = np.unique(of, return_index=True, return_inverse=True)
            a, b = s[chosen[where]], s[chosen[where] + 1]
            left.append(a)
            right.append(b)
            at.append(p[chosen[where]])
            length = length.copy()
            length[chosen] += length[chosen + 1]
            size.append(length[chosen[where]])
            s = s.copy()
            s[chosen] = self.first[-1] + which
            stays = np.ones(len(s), bool)
            stays[chosen + 1] = False
            s, d, p, length = s[stays], d[stays], p[stays], length[stays]
            self.first.append(self.first[-1] + len(kinds))
        none = np.zeros(0, np.int64)
        self.left, self.right, self.at = (np.concatenate([none, *x]) for x in (left, right, at))
        self.size = np.concatenate(size)
        self.roots, self.root_at = s, p

    @staticmethod
    def _choose(s: np.ndarray, inside: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
        """Places whose symbol joins the next one, and per place the number of the pair."""
        pair = np.where(inside, s[:-1] * symbols + s[1:], -1)
        _, of, count = np.unique(pair, return_inverse=True, return_counts=True)
        weight = np.frexp(count.astype(np.float64))[1].astype(np.int64) << 40
        weight |= (np.arange(len(count)) * 668265263) & ((1 << 40) - 1)  # one-to-one: the factor is odd
        weight = np.where(inside, weight[of], -1)
        # stretches of equal weight are one pair over and over; a stretch higher than both its neighbours is paired off
        new = np.flatnonzero(np.concatenate([[True], weight[1:] != weight[:-1]]))
        high = weight[new]
        before, after = np.concatenate([[-1], high[:-1]]), np.concatenate([high[1:], [-1]])
        peak = (high > before) & (high > after)
        size = np.diff(np.append(new, len(weight)))
        first, size = new[peak], (size[peak] + 1) // 2
        chosen = W.spans(np.zeros(len(first), np.int64), size) * 2 + np.repeat(first, size)
        return chosen, of[chosen]


class Extents:
    """How far words agree after (before) two places: by bisection over prefix hashes, or exactly over ranks."""

    def __init__(self, ids: np.ndarray, exact: bool = False):
        self.n = len(ids)
        self.exact = exact
        if exact:
            self.ranks = [ids]
            while (1 << len(self.ranks)) <= self.n:
                r, half = self.ranks[-1], 1 << (len(self.ranks) - 1)
                self.ranks.append(np.unique(r[:-half] * (int(r.max()) + 1) + r[half:], return_inverse=True)[1])
        else:
            h = W.mixed(ids.astype(np.uint64) + np.uint64(1))
            self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.n, W.BASE, np.uint64)]), dtype=np.uint64)
            self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.power[:-1], dtype=np.uint64)])

    def same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from i equal those from j (i < j)."""
        if not self.exact:
            return (self.prefix[i + size] - self.prefix[i]) * self.power[j - i] == self.prefix[j + size] - self.prefix[j]
        out = np.ones(len(i), bool)
        level = np.frexp(size.astype(np.float64))[1] - 1  # the largest power of two within size; two of them cover it
        for k in np.unique(level[size > 0]).tolist():
            m = np.flatnonzero((level == k) & (size > 0))
            r, back = self.ranks[k], size[m] - (1 << k)
            out[m] = (r[i[m]] == r[j[m]]) & (r[i[m] + back] == r[j[m] + back])
        return out

    def after(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Longest common stretch from i and j on, of at most ``most`` words."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            ok = self.same(i, j, np.where(open_, mid, 0))
            low, high = np.where(open_ & ok, mid, low), np.where(open_ & ~ok, mid - 1, high)
        return low

    def before(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Longest common stretch that ends just before i and j."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high + 1) // 2, 0)
            ok = self.same(i - mid, j - mid, mid)
            low, high = np.where(open_ & ok, mid, low), np.where(open_ & ~ok, mid - 1, high)
        return low


def crossing_runs(ids: np.ndarray, g: Grammar, min_length: int, exact: bool = False) -> tuple[np.ndarray, ...] | None:
    """Runs across the boundary of each rule, within it: rule, start (from the rule's), length, period.
    None if a hash claimed more than the words hold."""
    none = np.zeros(0, np.int64)
    large = np.flatnonzero(g.size[g.terms :] >= min_length)
    gram = -(-min_length // 6) + 1  # words at the boundary that recur a period away
    if not len(large) or len(ids) < gram:
        return none, none, none, none
    size = g.size[g.terms + large]
    lo, cut = g.at[large], g.at[large] + g.size[g.left[large]]
    hi = lo + size
    reach = size // MIN_PERIODS
    # places of the same few words are neighbours here, in order
    key = np.unique(W.rolling(W.mixed(ids.astype(np.uint64) + np.uint64(1)), gram), return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    n = len(ids) + 1
    ranked = key[order] * n + order

    def occurrences(at, low, high):
        """Places from low to high of the words at ``at``: as ranges in the order."""
        return np.searchsorted(ranked, key[at] * n + low), np.searchsorted(ranked, key[at] * n + high, side="right")

    ext = Extents(ids, exact)
    found = []
    for back in (True, False):
        # the longer side has min_length / 2 words at least: the words there, and one beyond the boundary, recur
        at = np.where(back, cut - gram + 1, cut - 1)
        can = (at >= lo) & (at + gram <= hi)
        rules, at = np.flatnonzero(can), at[can]
        if back:
            a, b = occurrences(at, np.maximum(lo[rules], at - reach[rules]), at - 1)
        else:
            a, b = occurrences(at, at + 1, np.minimum(hi[rules] - gram, at + reach[rules]))
        count = np.maximum(b - a, 0)
        ends = np.cumsum(count)
        s = 0
        while s < len(rules):
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + TRIED, side="right")))
            part, m = rules[s:e], count[s:e]
            r = np.repeat(part, m)
            q = np.abs(order[W.spans(a[s:e], m)] - np.repeat(at[s:e], m))
            s = e
            # what must agree on the longer side, and one word on the other
            need = np.maximum(-(-min_length // 2) - q, -(-q // 2))
            i = np.where(back, cut[r] - need - q, cut[r] - 1)
            fits = (i >= lo[r]) & (i + need + 1 + q <= hi[r])
            r, q, need, i = r[fits], q[fits], need[fits], i[fits]
            ok = ext.same(i, i + q, need + 1)
            r, q = r[ok], q[ok]
            i = cut[r] - q if back else cut[r]
            start = i - ext.before(i, i + q, i - lo[r])
            end = i + q + ext.after(i, i + q, hi[r] - i - q)
            long = end - start >= np.maximum(min_length, MIN_PERIODS * q)
            found.append((r[long], start[long], end[long], q[long]))
    r, start, end, q = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((q, end, start, r))
    r, start, end, q = r[by], start[by], end[by], q[by]
    first = np.ones(len(r), bool)
    first[1:] = (r[1:] != r[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    r, start, end, q = r[first], start[first], end[first], q[first]
    for x, y, p in zip(start.tolist(), end.tolist(), q.tolist()):
        if not np.array_equal(ids[x : y - p], ids[x + p : y]):
            return None
    return large[r], start - lo[r], end - start, q


def derived_runs(g: Grammar, rule: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs of rules at every place where the rule is derived: start, end, period, in the whole chunk."""
    n_rules, terms = len(g.left), g.terms
    count = np.bincount(rule, minlength=n_rules)
    first = np.cumsum(count) - count
    has = np.zeros(terms + n_rules, bool)
    has[terms:] = count > 0
    for k in range(len(g.first) - 1):
        own = slice(g.first[k], g.first[k + 1])
        r = slice(g.first[k] - terms, g.first[k + 1] - terms)
        has[own] |= has[g.left[r]] | has[g.right[r]]
    todo: list[list] = [[] for _ in g.first]  # by the round in which the symbol was made

    def push(symbols, places):
        live = has[symbols]
        symbols, places = symbols[live], places[live]
        made = np.searchsorted(g.first, symbols, side="right") - 1
        for k in np.unique(made).tolist():
            todo[k].append((symbols[made == k], places[made == k]))

    push(g.roots, g.root_at)
    out = [(np.zeros(0, np.int64),) * 3]
    for k in range(len(g.first) - 2, -1, -1):
        if not todo[k]:
            continue
        symbols, places = (np.concatenate(x) for x in zip(*todo[k]))
        todo[k] = []
        r = symbols - terms
        which = W.spans(first[r], count[r])
        place = np.repeat(places, count[r]) + start[which]
        out.append((place, place + length[which], period[which]))
        push(g.left[r], places)
        push(g.right[r], places + g.size[g.left[r]])
    return tuple(np.concatenate(x) for x in zip(*out))


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of one period that overlap by a period's length, as one; by start, then period."""
    by = np.lexsort((start, period))
    s, e, q = start[by], end[by], period[by]
    if not len(s):
        return s, e, q
    kind = np.cumsum(np.concatenate([[0], q[1:] != q[:-1]]))
    big = int(e.max()) + 1
    far = np.maximum.accumulate(e + kind * big) - kind * big  # within one period
    new = np.ones(len(s), bool)
    new[1:] = (q[1:] != q[:-1]) | (s[1:] + q[1:] > far[:-1])
    at = np.flatnonzero(new)
    s, e, q = s[at], np.maximum.reduceat(e, at), q[at]
    by = np.lexsort((q, s))
    return s[by], e[by], q[by]


def runs(ids: np.ndarray, doc_of: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, ...]:
    """All runs of documents given one after another: start, end, period; by start, then period."""
    g = Grammar(ids, doc_of)
    found = crossing_runs(ids, g, min_length)
    if found is None:
        found = crossing_runs(ids, g, min_length, exact=True)
    return merged(*derived_runs(g, *found))


def periodic_runs(docs: DataFrame, rearranged: Callable[[int | None, int], np.ndarray | None] | None = None, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then
    period) and collapsed, its words without those of a run after the run's first period.

    ``rearranged(doc_id, n)`` may name the places of the words to read instead of 0..n-1."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for a, b in text_chunks(texts, CHUNK):
                yield chunk(ids[a:b], texts[a:b])

    def chunk(ids, texts):
        lists = [t.split() for t in texts]
        if rearranged is not None:
            for k, (i, one) in enumerate(zip(ids, lists)):
                if (places := rearranged(i, len(one))) is not None:
                    lists[k] = [one[p] for p in places.tolist()]
        words, n = [w for one in lists for w in one], np.fromiter(map(len, lists), np.int64, len(lists))
        numbers, _ = W.number(words)
        s, e, q = runs(numbers, np.repeat(np.arange(len(n)), n), min_length)
        ends = np.cumsum(n)
        starts = ends - n
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, s + q, 1)
        np.add.at(step, e, -1)
        kept = np.cumsum(step[:-1]) == 0
        whole = np.ones(len(n), bool)
        doc = np.searchsorted(ends, s, side="right")
        whole[doc] = False
        collapsed = [b" ".join(one if w else compress(one, kept[x:y].tolist())) for one, w, x, y in zip(lists, whole.tolist(), starts.tolist(), ends.tolist())]
        at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n)))])
        run = pa.StructArray.from_arrays([pa.array(s - starts[doc]), pa.array(e - s), pa.array(q)], ["start", "length", "period"])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(n), pa.ListArray.from_arrays(pa.array(at, pa.int32()), run), pa.array(collapsed, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"],
        )

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def highest(found: Column) -> Column:
    """Of an array of runs the one of the greatest length per period, exactly; the first of equal ones."""
    more = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.when(F.size(found) > 0, F.reduce(found, F.get(found, 0), lambda best, r: F.when(more(best, r), r).otherwise(best)))
