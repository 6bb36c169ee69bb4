"""Operator 9: main text of web pages by differencing with the page of the nearest URL.

Pages of a host that lie next to each other in the order of their URL paths come
from one template.  Each page is paired with the neighbour, before or behind,
whose path shares more with its own; the two pages' lines (blocks of text) are
aligned by a longest common subsequence, and what both have is template and goes.

Differencing alone can't tell a menu that differs from page to page from text,
nor a paragraph that two articles really share from template.  Where the markup
says which it is, the markup decides: lines of an article or main element stay,
lines of navigation, footers, asides, forms, adverts, notices, comments and the
like go (also without a partner).  If a page has an article, its text is that; the
alignment decides about all other lines, and about those parts of the article that
only a piece of a class name speaks against (``related-work``, ``share-price``).

On Spark: a first pass parses every page for the hashes of its lines; neighbours
come from a sorted table of keys alone, and pages exchange hashes, never text; a
hot host is spread over as many tasks as it needs, since the order is cut by
ranges, and a neighbour beyond the end of a range is found through the first and
last key of each range.  A second pass parses again and joins each page with the
places of its shared lines, its text compressed on the way: parsing twice costs
less than keeping or moving the text twice.

Pages of one host with the same html are one page (copies would delete each other).
Near copies would too: neighbours are near copies if they share ``NEAR_SMALL`` of the
characters of the smaller page's open lines (those that markup says nothing about, or
the article's where a part of it is in doubt) and
``NEAR_LARGE`` of the larger one's.  They are joined to groups, a group is one page in
the order of paths, and this goes on until no nearest neighbours are near copies; a
group's pages are compared with the neighbour of the group.  A group without any other
page on its host is compared with nothing, like a page that is alone there.

Defined cases: null html counts as empty and gives an empty text; pages without a
URL or host are compared with nothing; repeated rows are each returned; an empty
table gives an empty result; other columns are ignored.  A very long page is read in
linear time and aligned in linear memory (time grows with the product of both pages'
lines where they differ).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .components import smallest_ids
from .html_blocks import CHROME, CONTENT, DOUBT, PLAIN, blocks
from .registry import map_arrow

JOIN = "\n\n"
#: Entries of a table of common subsequences; beyond it the lines are halved.
TABLE = 1 << 20
#: Shares of the characters of open lines by which neighbours are near copies.
NEAR_SMALL, NEAR_LARGE = 0.9, 0.5


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in a of a longest common subsequence with b."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = set(range(head)) | set(range(len(a) - tail, len(a)))
    there = set(b[head : len(b) - tail])
    rows = [i for i in range(head, len(a) - tail) if a[i] in there]
    mine = {a[i] for i in rows}
    cols = np.array([x for x in b[head : len(b) - tail] if x in mine], np.int64)
    if not rows:
        return out
    out |= {rows[i] for i in _longest(np.array([a[i] for i in rows], np.int64), cols)}
    return out


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of a with every prefix of b."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[:-1] + (b == x), row[1:]))
    return row


def _longest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places in a of a longest common subsequence with b, by halving a: memory is linear in the lines."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) > TABLE and a1 - a0 > 1:
            mid = (a0 + a1) // 2
            at = b0 + int((_lengths(a[a0:mid], b[b0:b1]) + _lengths(a[mid:a1][::-1], b[b0:b1][::-1])[::-1]).argmax())
            todo += [(a0, mid, b0, at), (mid, a1, at, b1)]
            continue
        table = np.zeros((a1 - a0 + 1, b1 - b0 + 1), np.int32)
        for r in range(1, a1 - a0 + 1):
            same = table[r - 1, :-1] + (b[b0:b1] == a[a0 + r - 1])
            table[r, 1:] = np.maximum.accumulate(np.maximum(same, table[r - 1, 1:]))
        r, c = a1 - a0, b1 - b0
        while r and c:
            if table[r, c] == table[r - 1, c]:
                r -= 1
            elif table[r, c] == table[r, c - 1]:
                c -= 1
            else:
                out.append(a0 + r - 1)
                r, c = r - 1, c - 1
    return out


def _pages(pages: DataFrame) -> DataFrame:
    """page_id, url, html, and what tells pages apart: host, path, page (a hash of host and html)."""
    url = F.col("url").cast("string")
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    t = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        url.alias("url"),
        F.nullif(F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit("")).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    return t.withColumn("page", F.xxhash64("host", "html"))


def line_hashes(pages: DataFrame) -> DataFrame:
    """page, host, path, hashes of its lines, characters of each line if open (else 0; no list for a page whose article is in no doubt)."""

    def run(batches):
        for batch in batches:
            hashes, sizes = [], []
            for h in batch.column("html").to_pylist():
                found = blocks(h)
                hashes.append([xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in found])
                says = {s for _, s in found}
                open_ = {CONTENT, DOUBT} if DOUBT in says else set() if CONTENT in says else {PLAIN}
                sizes.append([len(t) if s in open_ else 0 for t, s in found] if open_ else [])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page", "host", "path")), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))],
                ["page", "host", "path", "hashes", "sizes"],
            )

    t = pages.where("host IS NOT NULL").select("page", "host", "path", "html")
    return map_arrow(t, run, "page long, host string, path string, hashes array<long>, sizes array<int>")


def packed_lines(pages: DataFrame) -> DataFrame:
    """page_id, url, page, its lines and the markup's word on each, compressed."""

    def run(batches):
        writer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            got = []
            for h in batch.column("html").to_pylist():
                found = blocks(h)
                says = bytes(s + 1 for _, s in found)
                got.append(writer.compress(len(found).to_bytes(4, "little") + says + "\x00".join(t for t, _ in found).encode()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "page")), pa.array(got, pa.binary())], ["page_id", "url", "page", "packed"])

    return map_arrow(pages.select("page_id", "url", "page", "html"), run, "page_id long, url string, page long, packed binary")


def unpack(data: bytes) -> tuple[list[str], list[int]]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    return (raw[4 + n :].decode().split("\x00") if n else []), [x - 1 for x in raw[4 : 4 + n]]


def _shared_prefix(a, b):
    """Segments two paths have in common from the left."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.transform(F.sequence(F.lit(1), F.least(F.size(x), F.size(y))), lambda i: F.element_at(x, i).eqNullSafe(F.element_at(y, i)))
    first_difference = F.array_position(same, False)
    return F.when(first_difference == 0, F.size(same)).otherwise(first_difference - 1)


def nearest(keys: DataFrame) -> DataFrame:
    """(row, host, path) -> (row, partner): the neighbour in the host's order of paths with the longer common path.

    Ranges of the order are numbered by the table that holds them; only the first
    and last row of each range meet in one place, to be each other's neighbours."""
    order = ["host", "path", "row"]
    ranged = keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "url-ranges")
    inside = Window.partitionBy("range").orderBy(*order)
    here = ranged.select(
        "range",
        *order,
        F.lag(F.struct(*order)).over(inside).alias("before"),
        F.lead(F.struct(*order)).over(inside).alias("behind"),
    )
    ends = ranged.groupBy("range").agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last"))
    ranges = Window.orderBy("range")  # one row per range
    ends = ends.select("range", F.lag("last").over(ranges).alias("last_before"), F.lead("first").over(ranges).alias("first_behind"))
    both = here.join(ends, "range").select("row", "host", "path", F.coalesce("before", "last_before").alias("a"), F.coalesce("behind", "first_behind").alias("b"))
    score = {k: F.when(F.col(f"{k}.host") == F.col("host"), _shared_prefix(F.col("path"), F.col(f"{k}.path"))) for k in "ab"}
    partner = F.when(F.coalesce(score["a"], F.lit(-1)) >= F.coalesce(score["b"], F.lit(-1)), F.when(score["a"].isNotNull(), F.col("a.row"))).otherwise(F.col("b.row"))
    return both.select("row", partner.alias("partner")).where("partner IS NOT NULL")


def near_copies(mine: list[int], my_sizes: list[int], theirs: list[int], their_sizes: list[int]) -> bool:
    """Whether two pages share nearly all characters of their open lines."""
    a, b = sum(my_sizes), sum(their_sizes)
    if not a or not b:
        return False
    here = sum(my_sizes[i] for i in common_lines(mine, theirs))
    there = sum(their_sizes[i] for i in common_lines(theirs, mine))
    small, large = (here / a, there / b) if a <= b else (there / b, here / a)
    return small >= NEAR_SMALL and large >= NEAR_LARGE


def compared(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(row, partner) -> (page, partner, alike, shared): places of common lines; alike: near copies."""
    mine = lines.select(F.col("page").alias("row"), F.col("hashes").alias("mine"), F.col("sizes").alias("my_sizes"))
    theirs = lines.select(F.col("page").alias("partner"), F.col("hashes").alias("theirs"), F.col("sizes").alias("their_sizes"))

    def run(batches):
        for batch in batches:
            lists = [batch.column(c).to_pylist() for c in ("mine", "my_sizes", "theirs", "their_sizes")]
            alike = [near_copies(*x) for x in zip(*lists)]
            found = [sorted(common_lines(a, b)) for a, _, b, _ in zip(*lists)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("partner"), pa.array(alike, pa.bool_()), pa.array(found, pa.list_(pa.int32()))], ["page", "partner", "alike", "shared"]
            )

    both = pairs.join(theirs, "partner").join(mine, "row").select("row", "partner", "mine", "my_sizes", "theirs", "their_sizes")
    return map_arrow(both, run, "page long, partner long, alike boolean, shared array<int>")


def shared_lines(hashes: DataFrame) -> DataFrame:
    """page, places of the lines it has in common with the page of the nearest URL that is no near copy (pages with any)."""
    keys = hashes.groupBy("page", "host").agg(F.min("path").alias("path")).select(F.col("page").alias("row"), "host", "path")
    lines = hashes.groupBy("page").agg(F.first(F.struct("hashes", "sizes")).alias("x")).select("page", "x.hashes", "x.sizes")
    found = materialize(compared(nearest(keys), lines), "compared")
    copies = found.where("alike")
    if copies.isEmpty():
        return found.where(F.size("shared") > 0).select("page", "shared")

    # groups of near copies, by their links so far; every round compares one page of each group
    links = copies.select(F.col("page").alias("u"), F.col("partner").alias("v"))
    while True:
        links = materialize(links, "near-copies")
        groups = materialize(smallest_ids(links), "groups")
        others = groups.where("id <> component_id").select(F.col("id").alias("row"))
        pairs = nearest(keys.join(others, "row", "left_anti"))
        found = materialize(compared(pairs, lines), "compared")
        copies = found.where("alike")
        if copies.isEmpty():
            break
        links = links.unionByName(copies.select(F.col("page").alias("u"), F.col("partner").alias("v")))
    rest = groups.where("id <> component_id").join(found.select(F.col("page").alias("component_id"), "partner"), "component_id")
    # a page that is a near copy of its group's neighbour, though no page that stands for the group is, keeps its lines
    late = compared(rest.select(F.col("id").alias("row"), "partner"), lines).where("NOT alike")
    return found.unionByName(late).where(F.size("shared") > 0).select("page", "shared")


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    t = _pages(pages)
    hashes = materialize(line_hashes(t), "line-hashes")
    shared = materialize(shared_lines(hashes), "shared-lines")

    def run(batches):
        for batch in batches:
            text = []
            for data, places in zip(batch.column("packed").to_pylist(), batch.column("shared").to_pylist()):
                lines, says = unpack(data)
                template, article = set(places or ()), CONTENT in says or DOUBT in says
                keep = [x for i, (x, s) in enumerate(zip(lines, says)) if s == CONTENT or (s == DOUBT or not article and s != CHROME) and i not in template]
                text.append(JOIN.join(keep))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    both = packed_lines(t).join(shared, "page", "left").select("page_id", "url", "packed", "shared")
    return map_arrow(both, run, "page_id long, url string, text string, n_chars long")
