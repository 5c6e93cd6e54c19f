"""Main text of web pages by host-wide consensus on the container that holds it.

Each page scores its containers by the text that they hold outside links and boilerplate
and votes for the generalised tag-class path of the region around its best one; Spark adds
the votes up by host; every page is then extracted again from the path that won on its host,
with what its own region holds besides.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checked_broadcast, slices, store
from docloom.llm.html_tree import Page, parse
from docloom.llm.url_graph import host_of

#: Widest table of winning paths that is broadcast, in bytes; above it pages and paths meet by host.
PATH_BYTES = 32 << 20


def _own(page: Page) -> list[int]:
    """The characters outside links of each container's own blocks; a block of links counts against them."""
    own = [0] * len(page.labels)
    for c, text, linked in page.blocks:
        own[c] += max(0, len(text) - 2 * linked)
    return own


def scores(page: Page) -> list[float]:
    """Each container's text outside links, with half of what its children have."""
    own = [float(x) for x in _own(page)]
    for c in range(len(own) - 1, 0, -1):
        own[page.parents[c]] += own[c] / 2
    return own


def region(page: Page) -> tuple[int, list[int]]:
    """The container of the page's main text, and the characters outside links that each container holds in all.

    From the best-scored container the way goes up: to the outermost article or main around it
    and, where other articles hold a tenth of that one's text or more, to what holds them all.
    Without any it goes up to the outermost container that holds text of its own, or of
    several children, beside the one below: a lead, a second section or what surrounds a quotation.
    """
    held = _own(page)
    for c in range(len(held) - 1, 0, -1):
        held[page.parents[c]] += held[c]
    half = scores(page)
    way = [max(range(len(half)), key=lambda i: (half[i], -i))]
    while page.parents[way[-1]] >= 0:
        way.append(page.parents[way[-1]])
    named = [label.partition(".")[0] in ("article", "main") for label in page.labels]
    if outer := [c for c in way if named[c]]:
        rest = [c for c, n in enumerate(named) if n and 10 * held[c] >= held[outer[-1]]]
        # containers are numbered in page order, so those inside one follow it without a gap
        return next(c for c in way[way.index(outer[-1]) :] if c <= rest[0] and rest[-1] <= page.last[c]), held
    return next((c for below, c in list(zip(way, way[1:], strict=False))[::-1] if held[c] > held[below]), way[0]), held


def path_of(page: Page, container: int) -> str:
    """The generalised tag-class path of a container: labels from the root, with runs of digits as ``#``."""
    labels = []
    while container > 0:
        labels.append(page.labels[container])
        container = page.parents[container]
    return " ".join(reversed(labels))


def on_path(page: Page, path: str | None) -> list[bool]:
    """Whether each container has ``path`` or lies inside one that has."""
    wanted = path.split(" ") if path else []
    met, inside = [-1] * len(page.labels), [False] * len(page.labels)
    met[0], inside[0] = 0, path == ""
    for c in range(1, len(met)):
        above = page.parents[c]
        if 0 <= met[above] < len(wanted) and page.labels[c] == wanted[met[above]]:
            met[c] = met[above] + 1
        inside[c] = inside[above] or (met[c] > 0 and met[c] == len(wanted))
    return inside


def best_path(html: str | None) -> tuple[str, float] | None:
    """The path of the page's main region and the share of the page's text that it holds; None without text."""
    page = parse(html or "")
    if not page.blocks:
        return None
    c, held = region(page)
    total = sum(len(t) for _, t, _ in page.blocks)
    return path_of(page, c), min(1.0, held[c] / total)


def extract(html: str | None, path: str | None) -> str:
    """The blocks of all containers with ``path`` and of those inside them.

    The page's own main region joins them where it holds text that they lack.
    """
    page = parse(html or "")
    if not page.blocks:
        return ""
    own, _ = region(page)
    mine = lambda c: own <= c <= page.last[own]
    voted = on_path(page, path)
    found = any(voted[c] for c, _, _ in page.blocks)
    join = not found or any(mine(c) and not voted[c] and len(t) > 2 * n for c, t, n in page.blocks)
    return "\n".join(t for c, t, _ in page.blocks if voted[c] or (join and mine(c)))


def host_paths(pages: DataFrame) -> DataFrame:
    """``host``, ``path``: the winning path of each host; pages without text do not vote, ties go to the smaller path."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            tally: dict[tuple[str, str], float] = {}
            for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                if got := best_path(html):
                    tally[host, got[0]] = tally.get((host, got[0]), 0.0) + got[1]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in tally], pa.string()), pa.array([p for _, p in tally], pa.string()), pa.array(list(tally.values()), pa.float64())], names=["host", "path", "votes"])

    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    votes = rows.mapInArrow(vote, "host string, path string, votes double").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    best = votes.groupBy("host").agg(F.max(F.round("votes", 6)).alias("votes"))
    return votes.withColumn("votes", F.round("votes", 6)).join(best, ["host", "votes"]).groupBy("host").agg(F.min("path").alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text``, ``n_chars``.

    Null or empty html, and pages that hold nothing but boilerplate, give an empty text.
    Pages without a host share one vote.  Ids may be null or repeated.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [extract(h, p) for h, p in zip(b.column("html").to_pylist(), b.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    winners = store(host_paths(pages), "host-paths")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    joined = rows.join(checked_broadcast(winners, size=PATH_BYTES), "host", "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(apply, "page_id long, url string, text string, n_chars long")
