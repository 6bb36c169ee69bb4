"""Operator 10: document quality by a byte-level convolutional network in numpy.

A text is its UTF-8 bytes.  Overlapping chunks (``WIDTH`` bytes every ``STRIDE``)
cover the whole of it; each is embedded byte by byte and goes through learned
filters.  Activations are max-pooled over runs of ``POOL`` chunks; mean, maximum
and minimum of the pooled runs over the document give one logit and so one
probability, whatever the length.

Learning reads bytes of rows whose crc32(doc_id) mod 5 is not 0 and their
``labels.quality`` only: at most ``SAMPLE`` rows of each label, drawn by a hash,
of each at most ``WINDOW`` bytes at a time from a place that changes.  Scoring
reads every byte.

Defined cases: null counts as empty; an empty text is one chunk of padding;
without labelled rows every score is 0.5; a document with several labels is
learnt from each; repeated rows are each returned; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import held_out
from .registry import id_text, keep_rows, map_arrow

WIDTH, STRIDE, POOL = 16, 8, 64
EMBED, FILTERS = 6, 32
SAMPLE, WINDOW, STEPS, BATCH, RATE = 1_500, 2_048, 600, 50, 5e-3
THRESHOLD = 0.3
PAD = 256
#: Chunks whose activations are held at once.
AT_ONCE = 1 << 15


def chunks(data: bytes) -> np.ndarray:
    """Overlapping chunks of a text, padded to whole runs."""
    n = max(1, -(-max(0, len(data) - (WIDTH - STRIDE)) // STRIDE))
    runs = -(-n // POOL)
    padded = np.full((runs * POOL - 1) * STRIDE + WIDTH, PAD, np.int16)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[::STRIDE]


class Network:
    NAMES = ("embed", "filters", "bias", "out", "shift")

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (PAD + 1, EMBED)).astype(np.float32)
        self.embed[PAD] = 0
        self.filters = rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, 3 * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)

    def pooled(self, idx: np.ndarray) -> np.ndarray:
        """Max-pooled activations of whole runs of chunks."""
        out = []
        for a in range(0, len(idx), AT_ONCE):
            part = idx[a : a + AT_ONCE]
            z = self.embed[part].reshape(len(part), -1) @ self.filters
            out.append(z.reshape(-1, POOL, FILTERS).max(1))
        return np.maximum(np.concatenate(out) + self.bias, 0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of label 1; texts go through the filters together, in bounded portions."""
        features = np.zeros((len(texts), 3 * FILTERS), np.float32)
        held, rows, size = [], [], 0

        def flush():
            at = 0
            p = self.pooled(np.concatenate(held))
            for i, x in zip(rows, held):
                part = p[at : at + len(x) // POOL]
                features[i] = np.concatenate([part.mean(0), part.max(0), part.min(0)])
                at += len(part)

        for i, t in enumerate(texts):
            held.append(chunks(t))
            rows.append(i)
            size += len(held[-1])
            if size >= AT_ONCE:
                flush()
                held, rows, size = [], [], 0
        if held:
            flush()
        logit = features @ self.out + self.shift
        return 1 / (1 + np.exp(-logit.astype(np.float64)))

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over a batch."""
        parts = [chunks(t) for t in texts]
        runs = np.array([len(p) // POOL for p in parts])
        doc = np.repeat(np.arange(len(texts)), runs)
        idx = np.concatenate(parts)
        a = self.embed[idx].reshape(len(idx), -1)
        z = (a @ self.filters).reshape(-1, POOL, FILTERS)
        best = z.argmax(1)
        r = np.maximum(np.take_along_axis(z, best[:, None], 1)[:, 0] + self.bias, 0)
        first = np.concatenate([[0], np.cumsum(runs)[:-1]])
        mean = np.add.reduceat(r, first) / runs[:, None]
        top, low = np.maximum.reduceat(r, first), np.minimum.reduceat(r, first)
        h = np.concatenate([mean, top, low], 1)
        p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.shift, -30, 30)))
        d = ((p - labels) / len(labels)).astype(np.float32)
        dh = d[:, None] * self.out
        dmean, dtop, dlow = dh[:, :FILTERS], dh[:, FILTERS : 2 * FILTERS], dh[:, 2 * FILTERS :]
        dr = dmean[doc] / runs[doc, None] + dtop[doc] * (r == top[doc]) + dlow[doc] * (r == low[doc])
        dr = np.where(r > 0, dr, 0).astype(np.float32)
        # only the winning chunk of each run and filter passes the gradient on
        dz = np.zeros((len(idx), FILTERS), np.float32)
        dz[np.arange(len(r))[:, None] * POOL + best, np.arange(FILTERS)] = dr
        dfilters = a.T @ dz
        da = (dz @ self.filters.T).reshape(-1, EMBED)
        flat = idx.reshape(-1)
        dembed = np.stack([np.bincount(flat, da[:, e], PAD + 1) for e in range(EMBED)], 1).astype(np.float32)
        dembed[PAD] = 0
        return {"embed": dembed, "filters": dfilters, "bias": dr.sum(0), "out": h.T @ d, "shift": d.sum(keepdims=True)}

    def train(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        """Adam over shuffled batches, as many steps whatever the number of rows."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        v = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        order = np.zeros(0, np.int64)
        for step in range(1, steps + 1):
            if len(order) < min(BATCH, len(texts)):
                order = rng.permutation(len(texts))
            rows, order = order[:BATCH], order[BATCH:]
            rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
            at = [int(rng.integers(0, max(1, len(texts[i]) - WINDOW + 1))) for i in rows]
            g = self.gradients([texts[i][a : a + WINDOW] for i, a in zip(rows, at)], labels[rows])
            for k in self.NAMES:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                change = rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                getattr(self, k)[...] -= change.astype(np.float32)


def learn(docs: DataFrame, labels: DataFrame) -> Network | None:
    """Train on a bounded sample; None without labelled rows.

    Rows of both labels are drawn equally; the shift of the logit puts their
    true shares back, so that scores are probabilities."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    rows = rows.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id"), 5, 0))
    counts = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    if not counts:
        return None
    share = F.when(F.col("quality") == 1, F.lit(1.5 * SAMPLE / counts.get(1, 1))).otherwise(F.lit(1.5 * SAMPLE / counts.get(0, 1)))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0 < share).limit(4 * SAMPLE)
    # at most 4 * SAMPLE ids are broadcast; of a very long text a stretch from a hashed place is learnt from
    t = id_text(docs).where("doc_id IS NOT NULL")
    place = F.pmod(F.xxhash64("doc_id", "quality"), F.greatest(F.lit(1), F.length("text") - 4 * WINDOW + 1)).cast("int") + 1
    got = t.join(F.broadcast(drawn), "doc_id").select("doc_id", "quality", F.substring(F.col("text"), place, F.lit(4 * WINDOW)).alias("text"))
    table = got.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(4 * SAMPLE).toArrow()
    texts = [x.encode() for x in table.column("text").to_pylist()]
    y = np.array(table.column("quality").to_pylist(), np.float32)
    take = np.sort(np.concatenate([np.flatnonzero(y == k)[:SAMPLE] for k in (0, 1)]).astype(np.int64))
    net = Network()
    if len(take):
        net.train([texts[i] for i in take], y[take])
        ones, zeros = float((y[take] == 1).sum()), float((y[take] == 0).sum())
        if ones and zeros:
            net.shift += np.float32(np.log(counts[1] / counts[0]) - np.log(ones / zeros))
    return net


def judged(texts: list[str], net: Network | None) -> np.ndarray:
    """Score of each text; 0.5 without a network."""
    return np.full(len(texts), 0.5) if net is None or not texts else net.scores([t.encode() for t in texts])


def keep_good(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, as they are, that are predicted to be of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return keep_rows(docs, lambda texts: (judged(texts, shared.value) >= threshold).tolist())


def predict(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """Columns: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            s = judged(batch.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = map_arrow(id_text(docs), run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return predict(docs, learn(docs, labels))
