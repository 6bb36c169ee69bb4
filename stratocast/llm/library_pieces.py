"""Encoding of single pre-tokens by the tokenizers library's own model, behind a
bounded cache, for files whose pre-tokenizer is the byte-level one.

The library spends most of its time on walking the pattern and on alignments
nobody reads; here boundaries come from ``pretoken.split`` and the library's
model encodes only pre-tokens that the worker has not met lately.  A text that
holds the string of an added token goes through the library whole.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import public_tokenizers

from .piece_table import PieceTable
from .pretoken import split
from .registry import text_chunks

#: Characters whose boundaries are found at once.
CHUNK = 500_000


@cache
def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other
    bytes for code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


def byte_level(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(byte_letters())


def tokenizer_path(name: str) -> str:
    return name if "/" in name else public_tokenizers.path(name)


class LibraryEncoder:
    """Ids of whole texts as ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: type of the ids in memory and in files
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.table = PieceTable(self._piece, [self.dtype])

    def _piece(self, piece: str) -> tuple[list[int]]:
        return ([t.id for t in self.model.tokenize(byte_level(piece))],)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def special(self, text: str) -> bool:
        return any(a in text for a in self.added)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for a, b in text_chunks(texts, CHUNK):
            part = texts[a:b]
            p = split(part)
            ((flat, size),) = self.table.values(p)
            end = np.concatenate([[0], np.cumsum(size)])[p.first].tolist()
            out += [self.whole(t) if self.special(t) else flat[i:j] for t, i, j in zip(part, end, end[1:])]
        return out


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(name: str) -> LibraryEncoder:
    """One encoder per Python worker."""
    path = tokenizer_path(name)
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]
