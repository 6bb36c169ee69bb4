"""The observation store: a log of versions, folded into a base by compaction.

Layout under a root folder::

    log/obs_day=D/batch_id=N/    what micro-batch N said about day D
    base/gen-S/obs_day=D/        newest version of every key of day D, written by compaction S
    manifest/S.json              {"upto": B, "days": {D: generation}}: the base, and the last batch it holds

A reader takes the newest manifest, the generations it names and the log behind its
``upto``.  A manifest appears by one rename after all its files are written, so readers see
a whole base or the one before.  A compaction rewrites the days that the log touched since
the last one; ``vacuum`` then deletes log folders that are folded in and generations that
neither of the last two manifests names.  So what a read opens is one folder a day and the
batches since the last compaction, however many batches there were.

One writer: the job that ingests also compacts, between micro-batches.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import DAY, VERSION, read_store


def log_of(root: str) -> str:
    return f"{root}/log"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def manifests(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, f"{root}/manifest") if n.endswith(".json"))


def manifest(spark: SparkSession, root: str, number: int | None = None) -> dict:
    """The newest manifest (or that of a number); an empty one before the first compaction."""
    if number is None:
        there = manifests(spark, root)
        if not there:
            return {"number": -1, "upto": -1, "days": {}}
        number = there[-1]
    text = spark.read.text(f"{root}/manifest/{number}.json", wholetext=True).first()["value"]
    return {"number": number, **json.loads(text)}


def _publish(spark: SparkSession, root: str, number: int, content: dict) -> None:
    fs, final = _fs(spark, f"{root}/manifest/{number}.json")
    _, draft = _fs(spark, f"{root}/manifest/.{number}.draft")
    out = fs.create(draft, True)
    out.write(json.dumps(content).encode())
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"manifest {number} of {root} is there already: the store has another writer")


def _base(spark: SparkSession, root: str, days: dict[str, str]) -> DataFrame | None:
    """The named days of the base, with their day and a version below every batch's."""
    if not days:
        return None
    paths = [f"{root}/base/{gen}/{DAY}={d}" for d, gen in sorted(days.items())]
    rows = spark.read.parquet(*paths)
    day = F.to_date(F.regexp_extract(F.input_file_name(), rf"{DAY}=(\d{{4}}-\d{{2}}-\d{{2}})", 1))
    return rows.withColumn(DAY, day).withColumn(VERSION, F.lit(-1).cast("long"))


def _newest(versions: DataFrame, keys: Sequence[str], by_day: bool = False) -> DataFrame:
    """Newest version of each key: a partial aggregate, no window over a key's history."""
    rest = [c for c in versions.columns if c not in keys and c not in (VERSION, DAY)]
    group = [*keys, *([DAY] if by_day else [])]
    newest = versions.groupBy(*group).agg(F.max_by(F.struct(*rest), F.col(VERSION)).alias("_v"))
    return newest.select(*group, *[F.col("_v")[c].alias(c) for c in rest])


def _log(spark: SparkSession, root: str) -> DataFrame | None:
    rows = read_store(spark, log_of(root))
    return None if rows is None else rows.withColumn(VERSION, F.col(VERSION).cast("long"))


def versions(spark: SparkSession, root: str, since: str | None = None) -> DataFrame | None:
    """All versions that a reader needs: the base (of days from ``since`` on) and the log behind it; None if empty."""
    m = manifest(spark, root)
    base = _base(spark, root, {d: g for d, g in m["days"].items() if since is None or d >= since})
    log = _log(spark, root)
    if log is not None:
        log = log.filter(F.col(VERSION) > m["upto"])
        if since is not None:
            log = log.filter(F.col(DAY) >= F.lit(since).cast("date"))
    if base is None or log is None:
        return log if base is None else base
    return base.unionByName(log)


def read_latest(spark: SparkSession, root: str, keys: Sequence[str], since: str | None = None) -> DataFrame | None:
    """Newest version of each key in the store."""
    rows = versions(spark, root, since)
    return None if rows is None else _newest(rows, keys)


def compact(spark: SparkSession, root: str, keys: Sequence[str]) -> dict:
    """Fold the log into the base; returns the manifest then in force (the same if the log has nothing new).

    A key's versions lie in the folders of one day, as its time says."""
    m, log = manifest(spark, root), _log(spark, root)
    if log is None:
        return m
    new = log.filter(F.col(VERSION) > m["upto"])
    upto = new.agg(F.max(VERSION)).first()[0]
    if upto is None:
        return m
    touched = [str(r[DAY]) for r in new.select(DAY).distinct().collect()]  # days of the batches since, a handful
    base = _base(spark, root, {d: g for d, g in m["days"].items() if d in touched})
    rows = _newest(new if base is None else base.unionByName(new), keys, by_day=True)
    number = m["number"] + 1
    gen = f"gen-{number}"
    rows.repartition(DAY).write.mode("overwrite").partitionBy(DAY).parquet(f"{root}/base/{gen}")
    content = {"upto": int(upto), "days": {**m["days"], **dict.fromkeys(touched, gen)}}
    _publish(spark, root, number, content)
    return {"number": number, **content}


def vacuum(spark: SparkSession, root: str, followed: int | None = None) -> None:
    """Delete what readers no longer open.  ``followed``: the last batch that a query following the log is done
    with (None: nothing follows it); later folders stay for it."""
    there = manifests(spark, root)
    if not there:
        return
    last = [manifest(spark, root, n) for n in there[-2:]]
    folded = min(x["upto"] for x in last)  # a reader may still hold the manifest before
    folded = folded if followed is None else min(folded, followed)
    used = {f"{g}/{DAY}={d}" for x in last for d, g in x["days"].items()}
    for day in _names(spark, log_of(root)):
        if not day.startswith(f"{DAY}="):
            continue
        batches = [b for b in _names(spark, f"{log_of(root)}/{day}") if b.startswith(f"{VERSION}=")]
        old = [b for b in batches if int(b.split("=")[1]) <= folded]
        for b in old:
            _delete(spark, f"{log_of(root)}/{day}/{b}")
        if len(old) == len(batches):
            _delete(spark, f"{log_of(root)}/{day}")
    for gen in _names(spark, f"{root}/base"):
        days = [d for d in _names(spark, f"{root}/base/{gen}") if d.startswith(f"{DAY}=")]
        gone = [d for d in days if f"{gen}/{d}" not in used]
        for d in gone:
            _delete(spark, f"{root}/base/{gen}/{d}")
        if len(gone) == len(days):
            _delete(spark, f"{root}/base/{gen}")
    for n in there[:-2]:
        _delete(spark, f"{root}/manifest/{n}.json")
