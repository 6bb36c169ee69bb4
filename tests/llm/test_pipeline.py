"""The pipeline against brute force on the rows its classifiers keep, and the entry's guard."""

import os
import shutil
import subprocess
import sys
from collections import Counter

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from stratocast.sources.tables import load

from .test_duplicates import bag, components, jaccard
from .test_tokens import check_packing

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    docs = load(spark, SF, "documents")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in load(spark, SF, "labels").collect()}
    kept = set(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        got = docs.collect()
        now = {r["doc_id"] for r in got}
        assert len(now) == len(got) and now <= kept and all(r == rows[r["doc_id"]] for r in got)
        gone = kept - now
        if name == "language_id":
            assert not gone  # every text here has letters of a known language
        elif name == "quality":
            known = [labels[i] for i in gone if i in labels]
            assert known and sum(known) <= 0.2 * len(known)
        elif name == "exact_dedup":
            want = {}
            for i in kept:
                want[rows[i]["text"]] = max(i, want.get(rows[i]["text"], -1))
            assert now == set(want.values())
        else:
            ids = sorted(kept)
            bags = [bag(rows[i]["text"]) for i in ids]
            where = {}
            for k, b in enumerate(bags):
                for s in b:
                    where.setdefault(s, []).append(k)
            pairs = {(a, b) for v in where.values() for a in v for b in v if a < b}
            comp = components(len(ids), [(a, b) for a, b in pairs if jaccard(bags[a], bags[b]) >= 0.8])
            assert now == {ids[k] for k in set(comp)}
        kept = now
        docs = spark.createDataFrame(got, docs.schema) if got else docs
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_packing(out, [(i, rows[i]["text"]) for i in kept], Tokenizer.from_file(P.path("byte_bpe_50k.json")))


def test_empty_and_odd_documents(spark, make_docs, odd):
    for docs in (make_docs([]), make_docs(odd, {1: "en", 8: "mul", 11: "en"})):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns
                ids = Counter(r["doc_id"] for r in docs.collect())
                assert not Counter(r["doc_id"] for r in out.collect()) - ids


def _words(k, n=60):
    return " ".join(f"w{k}x{i}" for i in range(n))


def _left(stage, spark, docs):
    return Counter((r["doc_id"], r["text"]) for r in stage(spark, docs, SF).collect())


def test_exact_dedup_tells_rows_apart(spark, make_docs):
    rows = [(7, "same")] * 3 + [(None, "same")] * 2 + [(5, "a"), (5, "b"), (9, "b"), (None, "alone"), (None, "two"), (None, "two"), (-(1 << 63), "low"), (3, "low")]
    got = _left(corpus_pipeline.drop_exact_duplicates, spark, make_docs(rows).repartition(5))
    assert got == Counter([(7, "same"), (5, "a"), (9, "b"), (None, "alone"), (None, "two"), (3, "low")])


def test_near_dedup_tells_rows_apart(spark, make_docs):
    a, b, c, d = (_words(k) for k in range(4))
    rows = [(7, a)] * 3 + [(8, a + " end"), (None, a), (5, b), (5, c), (2, c + " end"), (None, d), (None, d)]
    got = _left(corpus_pipeline.drop_near_duplicates, spark, make_docs(rows).repartition(5))
    assert got == Counter([(7, a), (5, b), (2, c + " end"), (None, d)])


def test_filters_judge_each_row(spark, make_docs, monkeypatch):
    rows = [(i, ("der die das und " if i % 2 else "the of and to ") * 5 + str(i)) for i in range(60)]
    langs = {i: "de" if i % 2 else "en" for i, _ in rows}
    extra = [(1, "1 2 3"), (None, "the of and to " * 5), (None, "4 5"), (2, rows[2][1])]
    assert _left(corpus_pipeline.identify_language, spark, make_docs(rows + extra, langs)) == Counter(rows + [extra[1], extra[3]])

    monkeypatch.setattr(corpus_pipeline.quality_cnn, "learn", lambda docs, labels: None)
    monkeypatch.setattr(corpus_pipeline.quality_cnn, "judged", lambda texts, net: np.array([float(t.startswith("good")) for t in texts]))
    rows = [(1, "good"), (1, "bad"), (None, "good too"), (None, "bad too"), (2, "good"), (2, "good")]
    assert _left(corpus_pipeline.keep_quality, spark, make_docs(rows)) == Counter(r for r in rows if r[1].startswith("good"))


def test_run_leaves_no_table_of_its_stages(spark):
    from stratocast import session

    before = set(session._GIVEN)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in session._GIVEN if p not in before]
    assert out and [x for x in left if x.startswith("pipeline")] == ["pipeline-near_dedup"]
    assert not {"signatures", "dropped-rows", "fingerprint-blocks", "rows"} & set(left)


def test_entry_without_this_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(os.path.join(root, "stratocast"), tmp_path / "stratocast", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'wn_lags' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
