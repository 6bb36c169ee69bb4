"""Operator 7: token counts by a map-side two-tier lookup.

Tier one is a compact hash table of frequent pre-tokens with their numbers of tokens
(keys of 128 bits, no strings), broadcast once; ``TABLE`` entries bound its size.  Tier two is a bounded
cache in each worker, behind which the library's model encodes what neither
knows.  Counting is one map over the documents: no pre-token is ever shuffled.
The table comes from a bounded sample of rows (``SAMPLE``); it only saves time,
so counts don't depend on it.

The library's normaliser (NFC, white space, lower case) is followed only for
characters that it treats like Python's own functions, which a worker finds by
asking the library about each; a text with any other character, or with the
string of an added token, goes through the library whole.

Defined cases: null text: empty, 0 bytes and 0 tokens; repeated rows are each
returned; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .library_pieces import LibraryEncoder, byte_level, tokenizer_path
from .piece_table import LONG, FrequentTable, PieceTable, hashes
from .pretoken import Pieces, char_classes, split
from .registry import bounded_sample, id_text, map_arrow, text_chunks

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Rows whose pre-tokens are counted for the table, and entries of the table.
SAMPLE, TABLE = 2_000, 30_000
CHUNK = 500_000
#: Code points below this may take the short way, if the library agrees.
KNOWN = 0x2070


def split_number(n: int) -> list[int]:
    """Addends of n that fit 16 bits: one, but for pieces of over 65,535 tokens."""
    return [0xFFFF] * (n // 0xFFFF) + [n % 0xFFFF]


class WordCounter:
    """Numbers of tokens of whole texts as the library gives them."""

    def __init__(self, path: str, table: FrequentTable | None = None):
        self.library = LibraryEncoder(path)
        self.tokenizer = self.library.tokenizer
        self.frequent = table or FrequentTable([], [])
        self.cache = PieceTable(self._miss, [np.uint16])
        self.plain = self._plain()

    def _miss(self, piece: str) -> tuple[list[int]]:
        return (split_number(len(self.library.model.tokenize(byte_level(piece)))),)

    def _numbers(self, p: Pieces) -> np.ndarray:
        """Tokens of each piece: the broadcast table first, then the worker's cache."""
        entry = self.frequent.find(hashes(p))
        known = (entry >= 0) & (p.ends - p.starts <= LONG)
        out = np.zeros(len(entry), np.int64)
        out[known] = self.frequent.number[entry[known]]
        rest = np.flatnonzero(~known)
        ((found, size),) = self.cache.values(Pieces(p.joined, p.cp, p.starts[rest], p.ends[rest], p.first))
        total = np.concatenate([[0], np.cumsum(found, dtype=np.int64)])
        end = np.cumsum(size)
        out[rest] = total[end] - total[end - size]
        return out

    def _plain(self) -> np.ndarray:
        """Which code points the library normalises and splits as we do, whatever stands beside them."""
        good = np.zeros(0x110000, bool)
        norm, pre = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        classes = char_classes()
        for c in range(1, KNOWN):
            ch = chr(c)
            low = ch.lower()
            if unicodedata.category(ch)[0] == "M" or 0x1100 <= c < 0x1200 or c == 0x3A3:
                continue  # composes with, or depends on, its neighbours
            if classes[c] == 2:
                good[c] = norm.normalize_str(f"a{ch}b") == "a b"
            elif len(low) == 1 and classes[ord(low)] == classes[c] and norm.normalize_str(f"a{ch}b") == f"a{low}b":
                text = f"a{low}1{low}!"
                p = split([text], blanks=False)
                good[c] = [s for s, _ in pre.pre_tokenize_str(text)] == [byte_level(s) for s in p.strings()]
        return good

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for a, b in text_chunks(texts, CHUNK):
            part = texts[a:b]
            whole = [i for i, t in enumerate(part) if self.library.special(t) or not (t.isascii() and "\x00" not in t or self.plain[np.frombuffer(t.encode("utf-32-le"), np.uint32)].all())]
            short = list(part)
            for i in whole:
                short[i] = ""
            p = split("\x00".join(short).lower().split("\x00"), blanks=False)
            total = np.concatenate([[0], np.cumsum(self._numbers(p))])[p.first]
            n = (total[1:] - total[:-1]).tolist()
            for i in whole:
                n[i] = len(self.tokenizer.encode(part[i], add_special_tokens=False).ids)
            out += n
        return out

    def pieces(self, texts: list[str]) -> list[str]:
        return split([t.lower() for t in texts], blanks=False).strings()


_COUNTERS: dict[str, WordCounter] = {}


def frequent_table(docs: DataFrame, tokenizer: str = TOKENIZER, sample: int = SAMPLE, size: int = TABLE) -> FrequentTable:
    """Frequent pre-tokens and their numbers of tokens, as a hash table of a few hundred KB.

    Sample rows are counted where they are; only the counts of the ``size`` most
    frequent pre-tokens of each of a few tasks reach the driver."""

    def run(batches):
        seen: Counter[str] = Counter()
        counter = WordCounter(tokenizer_path(tokenizer))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in text_chunks(texts, CHUNK):
                seen.update(counter.pieces(texts[a:b]))
        top = [(k, v) for k, v in seen.most_common(size) if "\x00" not in k]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in top], pa.string()), pa.array([v for _, v in top], pa.int64()), pa.array([len(counter.library.model.tokenize(byte_level(k))) for k, _ in top], pa.int64())],
            ["piece", "seen", "n"],
        )

    rows = map_arrow(bounded_sample(docs.select("text"), sample), run, "piece string, seen long, n long")
    top = rows.groupBy("piece").agg(F.sum("seen").alias("seen"), F.max("n").alias("n")).orderBy(F.desc("seen"), "piece").limit(size).collect()
    short = [r for r in top if len(r["piece"]) <= LONG]
    return FrequentTable([r["piece"] for r in short], [r["n"] for r in short])


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """Columns: doc_id, n_bytes (UTF-8), n_tokens, over_limit."""
    t = id_text(docs)
    table = t.sparkSession.sparkContext.broadcast(frequent_table(t, tokenizer))

    def run(batches):
        if tokenizer not in _COUNTERS:
            _COUNTERS[tokenizer] = WordCounter(tokenizer_path(tokenizer))
        counter = _COUNTERS[tokenizer]
        counter.frequent = table.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = counter.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return map_arrow(t, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
