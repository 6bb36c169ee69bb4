"""Values of pre-tokens, looked up for a whole chunk of texts at once.

An open-addressing table in numpy arrays, keyed by 128 bits of hash.  A chunk's
pre-tokens are hashed from prefix sums of its characters, probed together, and
only those not met lately become Python strings and are handed to ``make``.
Values are runs of elements in flat pools, so the values of a text come out as
one array.  The table holds a bounded number of entries and starts anew when
full; ``make`` is pure, so that only costs time.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from .pretoken import Pieces

#: Pieces longer than this are never kept (and so never compared by hash).
LONG = 64
#: Fixed odd multipliers of the two polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@cache
def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _sized(n: int) -> int:
    return max(1 << 16, 1 << (n - 1).bit_length())


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of units[starts:ends] modulo 2**64, the same wherever the span lies."""
    size = _sized(len(units) + 1)
    total = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * _powers(base, size)[: len(units)], out=total[1:])
    back = _powers(pow(base, -1, 1 << 64), size)
    return mix((total[ends] - total[starts]) * back[starts])


def hashes(p: Pieces) -> list[np.ndarray]:
    return [span_hash(p.cp, p.starts, p.ends, b) for b in BASES]


def ragged(pool: np.ndarray, offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """pool[offset:offset + length] of every entry, one behind the other."""
    end = np.cumsum(length)
    if not len(end) or not end[-1]:
        return pool[:0]
    at = np.repeat(offset - (end - length), length)
    at += np.arange(end[-1])
    return pool[at]


class FrequentTable:
    """A fixed table from pieces to small numbers, as a few arrays that can be broadcast."""

    def __init__(self, pieces: list[str], numbers: list[int]):
        self.mask = np.uint64((1 << max(4, (2 * len(pieces)).bit_length())) - 1)
        self.slot = np.full(int(self.mask) + 1, -1, np.int32)
        self.number = np.array(numbers, np.uint16)
        ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
        cp = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        starts = ends - np.array([len(p) for p in pieces], np.int64)
        self.key = np.stack([span_hash(cp, starts, ends, b) for b in BASES])
        place(self.slot, self.mask, self.key[0], np.arange(len(pieces)))

    def find(self, h: list[np.ndarray]) -> np.ndarray:
        """Entry of each key, -1 where there is none."""
        return probe(self.slot, self.mask, self.key, h[0], h[1])


def place(slot: np.ndarray, mask: np.uint64, h1: np.ndarray, entries: np.ndarray) -> None:
    """Put entries with distinct keys into free slots, linear probing."""
    at, left = h1 & mask, np.arange(len(entries))
    while left.size:
        free = left[slot[at[left]] < 0]
        slot[at[free]] = entries[free]  # of several for one slot the last stays
        left = left[slot[at[left]] != entries[left]]
        at[left] = (at[left] + np.uint64(1)) & mask


def probe(slot: np.ndarray, mask: np.uint64, key: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    out = np.full(len(h1), -1, np.int64)
    at, left = h1 & mask, np.arange(len(h1))
    while left.size:
        e = slot[at[left]]
        there = e >= 0
        left, e = left[there], e[there]
        same = (key[0, e] == h1[left]) & (key[1, e] == h2[left])
        out[left[same]] = e[same]
        left = left[~same]
        at[left] = (at[left] + np.uint64(1)) & mask
    return out


class PieceTable:
    def __init__(self, make, dtypes, entries: int = 500_000):
        """``make(piece)`` gives one array-like per dtype."""
        self.make, self.dtypes, self.limit = make, [np.dtype(d) for d in dtypes], entries
        self.mask = np.uint64((1 << (2 * entries - 1).bit_length()) - 1)
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.slot = np.full(int(self.mask) + 1, -1, np.int32)
        self.key = np.zeros((2, self.limit), np.uint64)
        self.offset = [np.zeros(self.limit, np.int64) for _ in self.dtypes]
        self.length = [np.zeros(self.limit, np.int64) for _ in self.dtypes]
        self.pool = [np.zeros(1 << 16, d) for d in self.dtypes]
        self.used = [0] * len(self.dtypes)

    def _store(self, values: list[tuple]) -> np.ndarray:
        """Append entries; their numbers."""
        a, b = self.n, self.n + len(values)
        for k, d in enumerate(self.dtypes):
            arrays = [np.asarray(v[k], d) for v in values]
            size = np.fromiter(map(len, arrays), np.int64, len(arrays))
            self.length[k][a:b] = size
            self.offset[k][a:b] = self.used[k] + np.cumsum(size) - size
            total = self.used[k] + int(size.sum())
            if total > len(self.pool[k]):
                self.pool[k] = np.concatenate([self.pool[k], np.zeros(max(total, 2 * len(self.pool[k])) - len(self.pool[k]), d)])
            if total > self.used[k]:
                self.pool[k][self.used[k] : total] = np.concatenate(arrays)
            self.used[k] = total
        self.n = b
        return np.arange(a, b, dtype=np.int64)

    def values(self, p: Pieces) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each pool: the elements of all pieces, and how many each piece has."""
        got: list[list] = [[] for _ in self.dtypes]
        h = hashes(p)
        step = self.limit // 2
        for a in range(0, max(1, len(p.starts)), step):
            b = min(a + step, len(p.starts))
            for k, v in enumerate(self._some(p, h[0][a:b], h[1][a:b], a, b)):
                got[k].append(v)
        return [(np.concatenate([x for x, _ in g]), np.concatenate([y for _, y in g])) for g in got]

    def _some(self, p: Pieces, h1: np.ndarray, h2: np.ndarray, a: int, b: int):
        starts, ends = p.starts[a:b], p.ends[a:b]
        long = ends - starts > LONG
        entry = probe(self.slot, self.mask, self.key, h1, h2)
        entry[long] = -1
        miss = np.flatnonzero((entry < 0) & ~long)
        _, one, which = np.unique(h1[miss], return_index=True, return_inverse=True)
        if not (h2[miss][one][which] == h2[miss]).all():
            _, one, which = np.unique(np.stack([h1[miss], h2[miss]], 1), axis=0, return_index=True, return_inverse=True)
            which = which.reshape(-1)
        long = np.flatnonzero(long)
        if self.n + len(one) + len(long) > self.limit:
            self.clear()
            return self._some(p, h1, h2, a, b)
        new = miss[one]
        at = np.concatenate([new, long])
        if len(at):
            joined = p.joined
            made = self._store([self.make(joined[i:j]) for i, j in zip(starts[at].tolist(), ends[at].tolist())])
            fresh = made[: len(new)]
            self.key[0, fresh], self.key[1, fresh] = h1[new], h2[new]
            place(self.slot, self.mask, h1[new], fresh)
            entry[miss] = made[: len(new)][which]
            entry[long] = made[len(new) :]
        out = []
        for k in range(len(self.dtypes)):
            size = self.length[k][entry]
            out.append((ragged(self.pool[k], self.offset[k][entry], size), size))
        return out
