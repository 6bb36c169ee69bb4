"""Pre-token boundaries of many texts at once, as numpy array work.

Byte-level BPE vocabularies split a text by a pattern before any merge.  The
pattern only looks at the class of each character (letter, number, white space,
other), at single blanks and at a few contractions, so the boundaries of a whole
batch follow from comparing neighbouring classes; a regular-expression engine
that walks the text match by match takes many times as long.  The tests compare
every boundary with ``regex`` on the pattern itself.
"""

from __future__ import annotations

from functools import cache

import numpy as np

LETTER, NUMBER, SPACE, OTHER, BREAK = range(5)

#: The contractions that the public split patterns name.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def char_classes() -> np.ndarray:
    """Class of every code point, from the Unicode properties the patterns name."""
    import regex

    every = "".join("!" if 0xD800 <= c < 0xE000 else chr(c) for c in range(0x110000))
    classes = np.full(len(every), OTHER, np.uint8)
    for name, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(name, every):
            classes[m.start() : m.end()] = kind
    return classes


class Pieces:
    """The pre-tokens of a list of texts: ``joined[starts[i]:ends[i]]``; those of
    text d are ``first[d]`` to ``first[d + 1]``."""

    def __init__(self, joined: str, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
        self.joined, self.cp, self.starts, self.ends, self.first = joined, cp, starts, ends, first

    def strings(self) -> list[str]:
        joined = self.joined
        return [joined[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())]


def split(texts: list[str], blanks: bool = True) -> Pieces:
    """Pre-tokens of each text.

    ``blanks=True``: the pattern of the byte-level files - optional leading blank
    with a run of letters, of numbers or of others; runs of white space give their
    last blank to what follows.  ``blanks=False``: runs of letters, single numbers,
    runs of others, white space dropped (the pattern of the word-end file).
    Contractions stand alone in both.
    """
    joined = "\x00".join(texts)
    n = len(joined)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(lengths + 1) - lengths - 1
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = char_classes()[cp]
    kind[begin[1:] - 1] = BREAK
    # one more break behind the last text
    kind = np.append(kind, np.uint8(BREAK))
    cp = np.append(cp, np.uint32(0))

    mark = np.empty(n + 1, bool)
    mark[0] = True
    np.not_equal(kind[1:], kind[:-1], out=mark[1:])
    mark |= kind == BREAK
    runs = np.flatnonzero(mark)  # first character of each run of one class
    kinds = kind[runs]
    follows = kinds[:-1] == SPACE  # run i + 1 stands behind white space

    if blanks:
        word = kinds[1:] < BREAK  # what may take a leading blank
        at = runs[1:][follows & word]  # runs behind white space, not at a text's end
        last = at - 1
        blank = cp[last] == 0x20
        mark[last] = True  # a run of white space gives up its last character
        mark[at[blank]] = False  # which, if a blank, opens the next pre-token
    else:
        mark |= kind == NUMBER

    # contractions: a lone quote, with no blank in its pre-token, before certain letters
    quote = np.flatnonzero((kinds[:-1] == OTHER) & (cp[runs[:-1]] == 0x27) & (runs[1:] - runs[:-1] == 1) & (kinds[1:] == LETTER))
    if quote.size:
        at = runs[quote]
        if blanks:
            at = at[mark[at]]
        one, two = cp[at + 1], cp[np.minimum(at + 2, n)]
        size = np.zeros(len(at), np.int64)
        for c in CONTRACTIONS:
            fits = one == ord(c[0])
            if len(c) == 2:
                fits &= two == ord(c[1])
            size[fits & (size == 0)] = len(c)
        at, size = at[size > 0], size[size > 0]
        mark[at + 1] = False
        mark[at + 1 + size] = True

    starts = np.flatnonzero(mark)
    ends = np.append(starts[1:], n + 1)
    keep = kind[starts] != BREAK
    if not blanks:
        keep &= kind[starts] != SPACE
    starts, ends = starts[keep], ends[keep]
    first = np.append(np.searchsorted(starts, begin), len(starts)) if texts else np.zeros(1, np.int64)
    return Pieces(joined, cp, starts, ends, first)


class PieceCache(dict):
    """What one pre-token stands for, kept for ``limit`` pre-tokens at most.

    ``make(piece)`` is pure, so dropping an entry only costs time.  Half of the
    entries are the ones used since the last turn; when they are full they
    become the older half, from which what is used again comes back.
    """

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit // 2, {}

    def __missing__(self, piece):
        value = self.older.get(piece)
        if value is None:
            value = self.make(piece)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[piece] = value
        return value
