"""Multisets of five-word shingles of many texts at once, as arrays.

Words are what white space separates, unchanged.  A text of one to four words is
one shingle; a text without words has none.  A shingle is known by 48 bits of
hash.  A bag is the sorted distinct shingles with how often each stands there: two
documents' overlap is the sum of the lesser of both counts over what they share.
"""

from __future__ import annotations

import numpy as np

from .piece_table import BASES, mix, span_hash
from .pretoken import SPACE, char_classes

WORDS = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[str], words: int = WORDS) -> np.ndarray:
    """(text number << 48) + shingle of every shingle, sorted; repetitions included."""
    joined = "\x00".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(lengths + 1) - lengths - 1
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    gap = char_classes()[cp]
    # what str.split() takes as white space besides the Unicode property
    gap = (gap == SPACE) | ((cp >= 0x1C) & (cp <= 0x1F))
    gap[begin[1:] - 1] = True
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    word = span_hash(cp, starts, ends, BASES[0])
    doc = np.searchsorted(begin, starts, side="right") - 1
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    count = np.diff(first)

    out = []
    if len(word) >= words:
        last = len(word) - words + 1
        total = np.zeros(last, np.uint64)
        for k in range(words):
            total = total * _STEP + word[k : k + last]
        whole = doc[:last] == doc[words - 1 :]
        out.append((doc[:last][whole].astype(np.uint64) << np.uint64(48)) | (mix(total[whole]) >> np.uint64(16)))
    for d in np.flatnonzero((count > 0) & (count < words)).tolist():
        total = np.uint64(count[d])
        for w in word[first[d] : first[d + 1]].tolist():
            total = np.uint64((int(total) * int(_STEP) + w) & 0xFFFFFFFFFFFFFFFF)
        out.append(np.array([d << 48], np.uint64) | (mix(np.array([total])) >> np.uint64(16)))
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text number, shingle, times) of sorted keys."""
    if not len(keys):
        return np.zeros(0, np.int64), keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    times = np.diff(np.append(at, len(keys)))
    return (keys[at] >> np.uint64(48)).astype(np.int64), keys[at] & np.uint64((1 << 48) - 1), times


#: One entry of a bag.
ENTRY = np.dtype([("shingle", "<u8"), ("times", "<u4")])


def entries(doc: np.ndarray, shingle: np.ndarray, times: np.ndarray, texts: int) -> list[np.ndarray]:
    """The bag of each text, from ``counted``."""
    every = np.empty(len(doc), ENTRY)
    every["shingle"], every["times"] = shingle, times
    cut = np.searchsorted(doc, np.arange(texts + 1))
    return [every[a:b] for a, b in zip(cut.tolist(), cut[1:].tolist())]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Overlap of two bags."""
    _, i, j = np.intersect1d(a["shingle"], b["shingle"], assume_unique=True, return_indices=True)
    return int(np.minimum(a["times"][i], b["times"][j]).sum(dtype=np.int64))


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int) -> np.ndarray:
    """Overlap of every left bag with every right one (both sides not empty).

    For a shingle whose counts are l1 < l2 < ..., the lesser of two counts is the sum of the
    steps l1, l2 - l1, ... that both reach: so a column stands for a shingle and a count,
    weighs its step, and holds the bags that reach it; overlaps are a matrix product, taken
    ``columns`` columns at a time."""
    one, two = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(one["shingle"], two["shingle"])
    out = np.zeros((len(left), len(right)))
    if not len(both):
        return out
    far = np.int64(max(one["times"].max(), two["times"].max())) + 1

    def place(bag):
        """Of a bag's shingles that both sides hold: their number, and number and count in one."""
        bag = bag[np.isin(bag["shingle"], both)]
        which = np.searchsorted(both, bag["shingle"])
        return which, which * far + bag["times"]

    levels = np.unique(np.concatenate([place(one)[1], place(two)[1]]))
    which = levels // far
    new = np.concatenate([[True], which[1:] != which[:-1]])
    step = np.where(new, levels % far, np.diff(levels, prepend=0)).astype(np.float64)
    first = np.flatnonzero(new)

    def reached(bags):
        """(bag, column) of every column that a bag reaches, by column."""
        number, column = [], []
        for i, bag in enumerate(bags):
            w, level = place(bag)
            low, high = first[w], np.searchsorted(levels, level, side="right")
            size = high - low
            column.append(np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size))
            number.append(np.full(len(column[-1]), i))
        number, column = np.concatenate(number), np.concatenate(column)
        order = np.argsort(column, kind="stable")
        return number[order], column[order]

    (ln, lc), (rn, rc) = reached(left), reached(right)
    for s in range(0, len(levels), columns):
        e = min(len(levels), s + columns)

        def table(number, column, size):
            a, b = np.searchsorted(column, [s, e])
            t = np.zeros((size, e - s))
            t[number[a:b], column[a:b] - s] = 1
            return t

        out += (table(ln, lc, len(left)) * step[s:e]) @ table(rn, rc, len(right)).T
    return out


def bag_keys(doc: np.ndarray, shingle: np.ndarray, times: np.ndarray, texts: int) -> np.ndarray:
    """Two 64-bit hashes of each text's multiset (rows), zero where there are no shingles."""
    out = np.zeros((texts, 2), np.uint64)
    if len(doc):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        pair = mix(shingle) + times.astype(np.uint64) * _STEP
        out[doc[first], 0] = np.add.reduceat(mix(pair), first)
        out[doc[first], 1] = np.add.reduceat(mix(pair ^ np.uint64(BASES[1])), first)
    return out
