"""Registered queries: one per operator, on its whole table."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load
from .registry import query


@query("op1_bpe_roundtrip")
def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_tree import encode

    return encode(load(spark, sf_dir, "documents"))


SQL_EXACT = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""


@query("op2_exact_dedup", SQL_EXACT)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(load(spark, sf_dir, "documents"))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(load(spark, sf_dir, "documents"))


@query("op5_token_store")
def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import store_and_read

    return store_and_read(load(spark, sf_dir, "documents"))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(load(spark, sf_dir, "documents"))


SQL_LINKS = """
WITH RECURSIVE every AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
usable AS (SELECT vec_id, x, sqrt(list_sum([c * c FOR c IN x])) AS size FROM every
           WHERE len(x) > 0 AND len([c FOR c IN x IF c IS NULL OR NOT isfinite(c)]) = 0 AND list_sum([abs(c) FOR c IN x]) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
          WHERE list_dot_product(a.x, b.x) / a.size / b.size >= 0.95),
reach AS (SELECT vec_id AS u, vec_id AS v FROM every UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
smallest AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
counted AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM every JOIN smallest s ON s.u = vec_id LEFT JOIN counted c ON c.u = vec_id
"""


@query("op3_embedding_links", SQL_LINKS)
def op3_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cover_tree import linked_vectors

    return linked_vectors(load(spark, sf_dir, "embeddings"))


@query("op6_near_duplicates")
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bag_minhash import near_duplicates

    return near_duplicates(load(spark, sf_dir, "documents"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(load(spark, sf_dir, "documents"))


@query("op9_page_text")
def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .page_diff import extract

    return extract(load(spark, sf_dir, "pages"))


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_cnn import score_quality

    return score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


SQL_REPEATED = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
each_word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS s FROM texts),
windows AS (SELECT doc_id, s, k FROM (SELECT doc_id, s, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS k,
            count(*) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n FROM each_word) WHERE n = 20),
firsts AS (SELECT k, min((doc_id, s)) AS f FROM windows GROUP BY k),
judged AS (SELECT doc_id, s, (doc_id, s) <> f AS again FROM windows JOIN firsts USING (k)),
covered AS (SELECT doc_id, s, word, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
            FROM each_word LEFT JOIN judged USING (doc_id, s))
SELECT t.doc_id, CAST(len(t.words) AS BIGINT) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY s) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM texts t LEFT JOIN covered c ON c.doc_id = t.doc_id GROUP BY t.doc_id, t.words
"""


@query("op12_repeated_passages", SQL_REPEATED)
def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .super_kmers import drop_repeated

    found = drop_repeated(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def planted_period(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words to read in a document whose words are made periodic from one place on; None: as they are."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .period_runs import highest, periodic_runs

    found = periodic_runs(load(spark, sf_dir, "documents"), planted_period).withColumn("best", highest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


SQL_NEGATIVES = """
WITH usable AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                WHERE label IS NOT NULL AND len(embedding) > 0 AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
vectors AS (SELECT vec_id, label, [floor(256 * c) FOR c IN e] AS x FROM usable),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
           FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER best <= 5
"""


@query("op11_hard_negatives", SQL_NEGATIVES)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
