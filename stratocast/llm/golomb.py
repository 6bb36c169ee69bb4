"""Golomb (Rice) coding of sorted 64-bit numbers, vectorised.

Gaps are split into a quotient (unary) and a remainder (fixed width); the two
streams lie one behind the other, so both can be read back as arrays.
"""

from __future__ import annotations

import math
import struct

import numpy as np

_HEAD = struct.Struct("<QQB")  # numbers, bits of the unary stream, bits of a remainder


def encode(values: np.ndarray, low: int, high: int) -> bytes:
    """Code sorted uint64 ``values`` from the range [low, high)."""
    n = len(values)
    if not n:
        return _HEAD.pack(0, 0, 0)
    k = max(0, min(63, int(math.log2(max(1.0, math.log(2) * (high - low) / n)))))
    gaps = np.diff(values, prepend=np.uint64(low))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1) - 1  # where the unary codes' zero bits lie
    unary = np.ones(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 0
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return _HEAD.pack(n, len(unary), k) + np.packbits(unary).tobytes() + np.packbits(rest.reshape(-1)).tobytes()


def decode(code: bytes, low: int) -> np.ndarray:
    n, bits, k = _HEAD.unpack_from(code)
    if not n:
        return np.zeros(0, np.uint64)
    at = _HEAD.size
    size = -(-bits // 8)
    unary = np.unpackbits(np.frombuffer(code, np.uint8, size, at), count=bits)
    quotient = np.diff(np.flatnonzero(unary == 0), prepend=-1) - 1
    rest = np.unpackbits(np.frombuffer(code, np.uint8, offset=at + size), count=n * k).reshape(n, k)
    remainder = np.zeros(n, np.uint64)
    for j in range(k):
        remainder = (remainder << np.uint64(1)) | rest[:, j].astype(np.uint64)
    return np.cumsum((quotient.astype(np.uint64) << np.uint64(k)) + remainder, dtype=np.uint64) + np.uint64(low)
