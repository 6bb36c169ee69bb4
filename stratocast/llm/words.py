"""Words of whole texts, and numbers for them, shared by the operators on word sequences.

A word is a stretch of bytes other than space and the controls 9 to 13; it is
taken unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .piece_table import span_hash

#: Odd multiplier of the polynomial hashes (fixed value).
BASE = 0x9E3779B97F4A7C15


def number(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Per word the number of its value (equal words, equal numbers), and the distinct words."""
    if not words:
        return np.zeros(0, np.int64), []
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
#: Bytes hashed at once.
_HASHED = 1 << 18


class Tokens:
    """Words of texts one after another, as arrays: ``buf`` holds them with one space between, word i
    is buf[starts[i]:ends[i]] and has the 64-bit hash h[i]; ``count`` says how many each text has."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        gap = _GAP[raw]
        edge = np.concatenate([[True], gap[:-1]]) if len(gap) else gap  # behind a gap
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        bounds = np.concatenate([[0], np.cumsum(size)])
        self.count = np.diff(np.searchsorted(np.flatnonzero(~gap & edge), bounds))
        stays = ~(gap & edge)
        self.buf = raw[stays]
        self.buf[gap[stays]] = 32
        spaces = np.flatnonzero(self.buf == 32)
        if len(self.buf) and (not len(spaces) or spaces[-1] != len(self.buf) - 1):
            spaces = np.append(spaces, len(self.buf))
        self.starts, self.ends = np.concatenate([[0], spaces[:-1] + 1]) if len(spaces) else spaces, spaces
        self.h = np.empty(len(spaces), np.uint64)
        s = 0
        while s < len(spaces):
            e = max(s + 1, int(np.searchsorted(self.ends, self.starts[s] + _HASHED)))
            low = self.starts[s]
            self.h[s:e] = span_hash(self.buf[low : self.ends[e - 1]], self.starts[s:e] - low, self.ends[s:e] - low, BASE)
            s = e

    def numbers(self) -> np.ndarray:
        """Equal words, equal numbers, whatever the hashes say."""
        return number(self.buf.tobytes().split())[0]


def rolling(h: np.ndarray, size: int, base: int = BASE) -> np.ndarray:
    """Hash of every stretch of ``size`` words, by doubling; entry i is that of words i to i + size - 1."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, block, width = None, 0, h, 1
    rest = size
    while rest:
        if rest & 1:
            part = block[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(base, width, 1 << 64)) + part
            done += width
        rest >>= 1
        if rest:
            block = block[:-width] * np.uint64(pow(base, width, 1 << 64)) + block[width:]
            width *= 2
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """One-to-one scrambling of 64-bit numbers (constants of a well-known finaliser)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0] .. first[0]+size[0]-1, first[1] .. and so on, in one array."""
    total = int(size.sum())
    ends = np.cumsum(size)
    return np.arange(total) + np.repeat(first - (ends - size), size)
