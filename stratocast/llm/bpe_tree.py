"""Operator 1: byte-level BPE encoding and decoding by monoid tree reduction.

Encodings of byte strings form a monoid under "join": the encoding of a + b
follows from those of a and b.  A pre-token is cut in halves, the halves are
encoded recursively, and neighbours are joined by encoding anew a window of
tokens around the seam.  The window grows until the pairs (last token left of
it, its first token) and (its last token, first token right of it) are stable,
i.e. encode to themselves; a sequence of tokens whose adjacent pairs are all
stable is the BPE encoding of its bytes, so what lies outside is final.
Pre-tokens are separate by definition, so above them a join is concatenation;
decoding concatenates token bytes up the same tree.

On Spark each document is one row of a map without shuffle; a worker keeps a
bounded cache from pre-token to (ids, bytes).

Defined cases: a null text counts as empty, an empty text has no tokens (both
digests are those of zero bytes); repeated rows are each returned; an empty
table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .piece_table import PieceTable
from .pretoken import PieceCache, split
from .registry import id_text, map_arrow, text_chunks

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes encoded directly at the leaves of the tree.
LEAF = 8
#: Entries of each worker-side cache.
CACHE = 200_000
#: Characters whose boundaries are found at once.
CHUNK = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class TreeBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._leaves = PieceCache(self._merge, CACHE)
        self._windows = PieceCache(lambda t: self._merge(b"".join(map(self.bytes_of.__getitem__, t))), CACHE)

    # --- leaves -----------------------------------------------------------
    def _merge(self, piece: bytes) -> tuple[int, ...]:
        """Merges of lowest rank first, the leftmost of equals first."""
        if len(piece) > 64:
            return self._merge_long(piece)
        get, parts = self.ranks.get, [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best = None
            for i, r in enumerate(pairs):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return tuple(self.ranks[p] for p in parts)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1])

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap over a linked list: n log n for windows that grew long."""
        n, get = len(piece), self.ranks.get
        part = [piece[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 1, 1) for i in range(n - 1) if (r := get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not part[i] or j >= n or len(part[i]) != a or len(part[j]) != b:
                continue  # one of the two has been merged since
            part[i], part[j] = part[i] + part[j], b""
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, len(part[i]), len(part[k])))
            if (h := left[i]) >= 0 and (r := get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, len(part[h]), len(part[i])))
        return tuple(self.ranks[p] for p in part if p)

    # --- the monoid -------------------------------------------------------
    def _stable(self, a: int, b: int) -> bool:
        return self._windows[a, b] == (a, b)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """Encoding of the bytes of two encodings one behind the other."""
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = left[len(left) - i :] + right[:j]
            mid = self._windows[window] if len(window) <= 4 else self._merge(b"".join(map(self.bytes_of.__getitem__, window)))
            ok_left = i == len(left) or self._stable(left[-i - 1], mid[0])
            ok_right = j == len(right) or self._stable(mid[-1], right[j])
            if ok_left and ok_right:
                return left[: len(left) - i] + mid + right[j:]
            if not ok_left:
                i *= 2
            if not ok_right:
                j *= 2

    def tree(self, piece: bytes) -> tuple[int, ...]:
        if len(piece) <= LEAF:
            return self._leaves[piece] if piece else ()
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one pre-token; a pre-token that is itself a token is taken whole, as the library does."""
        b = piece.encode()
        r = self.ranks.get(b)
        return (r,) if r is not None else self.tree(b)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_MODELS: dict[str, TreeBPE] = {}


def model(path: str) -> TreeBPE:
    """One model per Python worker."""
    if path not in _MODELS:
        _MODELS[path] = TreeBPE(load_ranks(path))
    return _MODELS[path]


def encode(docs: DataFrame, ranks: str = RANKS, ids: bool = False) -> DataFrame:
    """Encode and decode every whole text.  Columns: doc_id, n_tokens, ids_sha256,
    decoded_sha256 and, with ``ids=True``, the token ids themselves."""

    def run(batches):
        bpe = model(public_tokenizers.path(ranks) if "/" not in ranks else ranks)

        def make(piece):
            t = bpe.encode_piece(piece)
            return np.frombuffer(("".join(f"{i}," for i in t)).encode(), np.uint8), np.frombuffer(bpe.decode(t), np.uint8)

        table = PieceTable(make, [np.uint8, np.uint8])
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = []
            for a, b in text_chunks(texts, CHUNK):
                p = split(texts[a:b])
                bounds = []
                for flat, size in table.values(p):
                    bounds.append((flat, np.concatenate([[0], np.cumsum(size)])[p.first].tolist()))
                (numbers, n), (decoded, d) = bounds
                for k in range(b - a):
                    decimal = numbers[n[k] : max(n[k], n[k + 1] - 1)].tobytes()  # without the last comma
                    out.append(
                        (
                            decimal.count(b",") + 1 if decimal else 0,
                            hashlib.sha256(decimal).hexdigest(),
                            hashlib.sha256(decoded[d[k] : d[k + 1]]).hexdigest(),
                            [int(x) for x in decimal.split(b",")] if ids and decimal else [],
                        )
                    )
            columns = [batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.array([x[3] for x in out], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_arrow(id_text(docs), run, schema + (", ids array<int>" if ids else ""))
