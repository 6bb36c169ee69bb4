"""Operator 8: language identification by a string kernel.

The kernel is the blended spectrum: for n = 1 to 4, which letter n-grams a text
holds (presence, not counts), hashed into a table per n; the cosine of the two
presence vectors, averaged over n.  A bounded sample of labelled texts gives
Nystroem landmarks and the rows on which one-versus-rest kernel ridge regression
is solved.  Since the kernel is an inner product of presence vectors, landmarks
and coefficients fold into one matrix, and a batch of whole texts is scored by
one product of its presence matrix with it.

Learning reads text and lang only, of rows whose crc32(doc_id) mod 4 is not 2.
``PER_LANGUAGE`` rows a language at most are fitted; landmarks are taken in turn
from the languages.

Defined cases: null text or a text without letters: ``und``, score 0; without
any labelled row every text is ``und``; repeated rows are each returned; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_table import mix
from .pretoken import LETTER, char_classes
from .registry import id_text, keep_rows, map_arrow

UNKNOWN = "und"
#: Buckets of the presence table of each n (n = 1, 2, ...).
BUCKETS = (256, 2_048, 8_192, 16_384)
PER_LANGUAGE, LANGUAGES, LANDMARKS = 400, 200, 256
RIDGE = 1e-3
#: Texts scored by one matrix product.
BATCH = 64
_START = np.concatenate([[0], np.cumsum(BUCKETS)]).astype(np.int64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def presence(text: str, out: np.ndarray) -> bool:
    """Mark the n-grams of one whole text in a zeroed row; false if it has no letter."""
    cp = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = char_classes()[cp] == LETTER
    if not letter.any():
        return False
    # other characters count as one blank; texts end with one on either side
    c = np.concatenate([[32], np.where(letter, cp, 32), [32]]).astype(np.uint64)
    solid = np.concatenate([[False], letter, [False]])
    c = c[np.concatenate([[True], solid[1:] | solid[:-1]])]
    h = np.zeros(len(c), np.uint64)
    for n, size in enumerate(BUCKETS):
        if len(c) <= n:
            break
        h = (h[: len(c) - n] + c[n:]) * _STEP
        out[_START[n] + ((h >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64)] = 1
    return True


def feature_rows(marks: np.ndarray) -> np.ndarray:
    """Presence rows (0/1) as vectors whose inner product is the kernel."""
    x = marks.astype(np.float32)
    for n in range(len(BUCKETS)):
        part = x[:, _START[n] : _START[n + 1]]
        size = part.sum(1, keepdims=True)
        part /= np.sqrt(np.maximum(size, 1) * len(BUCKETS))
    return x


def fit(packed: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """Languages and the folded matrix (features x languages), from presence rows as bits."""
    width = int(_START[-1])
    names = sorted(set(langs))
    if not names:
        return [], np.zeros((width, 0), np.float32)
    y = (np.array(langs)[:, None] == np.array(names)[None, :]).astype(np.float64)
    turn = np.zeros(len(langs), np.int64)  # place of a row among those of its language
    for k in range(len(names)):
        rows = np.flatnonzero(y[:, k])
        turn[rows] = np.arange(len(rows))
    chosen = np.argsort(turn, kind="stable")[:landmarks]

    def features(rows):
        return feature_rows(np.unpackbits(packed[rows], axis=1, count=width))

    z = features(chosen)
    k_nz = np.concatenate([features(np.arange(a, min(a + BATCH, len(langs)))) @ z.T for a in range(0, len(langs), BATCH)]).astype(np.float64)
    k_zz = k_nz[chosen]
    left = k_nz.T @ k_nz + ridge * len(langs) * k_zz + 1e-8 * np.eye(len(chosen))
    weights = np.linalg.solve(left, k_nz.T @ y)
    return names, (z.T @ weights.astype(np.float32)).astype(np.float32)


def held_out(doc_id, modulus: int, rest: int):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Fit on a bounded sample, spread by a hash over the rows that may be learnt from."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    share = spark.createDataFrame([(r["lang"], 2.0 * PER_LANGUAGE / r["count"]) for r in counts], "lang string, share double")
    drawn = (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0) < F.col("share")
    sample = rows.join(F.broadcast(share), "lang").where(drawn).select("text", "lang")

    def run(batches):
        row = np.zeros(int(_START[-1]), np.uint8)
        for batch in batches:
            bits, langs = [], []
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                row[:] = 0
                if presence(text, row):
                    bits.append(np.packbits(row).tobytes())
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(bits, pa.binary())], ["lang", "bits"])

    # a bounded number of rows (twice PER_LANGUAGE each, before the cut below) of a few KB
    got = map_arrow(sample, run, "lang string, bits binary").limit(4 * PER_LANGUAGE * max(1, len(counts))).collect()
    taken: dict[str, int] = {}
    bits, langs = [], []
    for r in sorted(got, key=lambda r: bytes(mix(np.frombuffer(bytes(r["bits"])[:64], np.uint64)).tobytes())):
        if taken.get(r["lang"], 0) < PER_LANGUAGE:
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
            bits.append(bytes(r["bits"]))
            langs.append(r["lang"])
    return fit(np.frombuffer(b"".join(bits), np.uint8).reshape(len(langs), int(_START[-1]) // 8), langs)


def tell(texts: list[str], names: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    pred, score = [], []
    for a in range(0, len(texts), BATCH):
        part = texts[a : a + BATCH]
        marks = np.zeros((len(part), int(_START[-1])), np.uint8)
        known = [presence(t, marks[i]) and bool(names) for i, t in enumerate(part)]
        f = np.clip(feature_rows(marks) @ matrix, 0, 1) if names else np.zeros((len(part), 1))
        top = f.argmax(1)
        share = f.max(1) / np.maximum(f.sum(1), 1e-9)
        pred += [names[k] if ok else UNKNOWN for k, ok in zip(top.tolist(), known)]
        score += [float(s) if ok else 0.0 for s, ok in zip(share.tolist(), known)]
    return pred, score


def keep_known(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float) -> DataFrame:
    """The rows, as they are, of which a learned language is predicted with a score of ``least`` or more."""
    names, folded = model
    shared = docs.sparkSession.sparkContext.broadcast(folded)

    def judge(texts):
        return [p != UNKNOWN and s >= least for p, s in zip(*tell(texts, names, shared.value))]

    return keep_rows(docs, judge)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Columns: doc_id, held_out, lang_pred, score."""
    names, folded = model
    shared = docs.sparkSession.sparkContext.broadcast(folded)

    def run(batches):
        for batch in batches:
            pred, score = tell(batch.column("text").to_pylist(), names, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = map_arrow(id_text(docs), run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, learn(docs))
