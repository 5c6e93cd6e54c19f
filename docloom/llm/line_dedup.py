"""Removal of line runs that repeat across documents, by winnowing over line hashes.

A gram is the shortest run of lines from some line on that has GRAM_WORDS words, a
window the shortest that has MIN_WORDS.  Every window selects its smallest gram hash
(the last among equals); the places selected in a document are its fingerprints, each once.
Two equal runs of MIN_WORDS words contain an equal window and so select the same gram: no
such run is missed.  Places are joined by gram; where a gram repeats, its windows name
the first place that has the same one, from there the match is extended line by line both
ways, and the later run is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checked_broadcast, mix, range_hashes, slices, store, utf8, words_of

#: Words of a gram, and of a run that is deleted.
GRAM_WORDS, MIN_WORDS = 25, 50
#: Lines beyond the matched ones that are compared first; a match that goes on further is looked at again, REACH_STEP times as far.
REACH, REACH_STEP = 64, 16
LINES = "doc_id long, version long, lines array<long>, words array<int>, marks array<struct<gram:long,line:int,windows:array<long>>>"
PAIR = ["doc_id", "version", "other", "other_version"]


def line_table(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and word count of every line of all texts, and the first line of each text (with the total)."""
    data, off = utf8(text)
    starts, _, _, _ = words_of(data, off)
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([off[1:], breaks]), kind="stable")
    n_lines = np.diff(np.searchsorted(breaks, off)) + 1
    words = np.searchsorted(starts, end) - np.searchsorted(starts, begin)
    return range_hashes(data, begin, end), words, np.concatenate([[0], np.cumsum(n_lines)])


_BASE = 0xC2B2AE3D27D4EB4F
_INV = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _last_smallest(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The place of the smallest value of each range [low, high], the last among equals."""
    best = np.arange(len(values))
    out = np.zeros(len(low), np.int64)
    depth = np.frexp((high - low + 1).astype(float))[1] - 1
    for k in range(int(depth.max()) + 1 if len(low) else 0):
        mine = np.flatnonzero(depth == k)
        a, b = best[low[mine]], best[high[mine] - (1 << k) + 1]
        out[mine] = np.where(values[b] <= values[a], b, a)
        if len(best) > 1 << k:
            a, b = best[: len(best) - (1 << k)], best[1 << k :]
            best = np.where(values[b] <= values[a], b, a)
    return out


def fingerprints(lines: np.ndarray, words: np.ndarray, first: np.ndarray, gram_words: int = GRAM_WORDS, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of all texts its hash, the line of the gram that it selects, and the hash of that.

    ``first`` has the first line of each text; windows start at lines with words.
    """
    n = len(lines)
    total = np.concatenate([[0], np.cumsum(words)])
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lines * _powers(_BASE, n), dtype=np.uint64)])
    inverse = _powers(_INV, n + 1)
    stop = np.repeat(first[1:], np.diff(first))
    at = np.arange(n)

    def runs(least: int) -> tuple[np.ndarray, np.ndarray]:
        """The end of the shortest run from each line with ``least`` words (past all lines if its text has none), and its hash."""
        end = np.searchsorted(total, total[:-1] + least, side="left")
        inside = np.minimum(end, n)
        return np.where(end <= stop, end, n + 1), mix((prefix[inside] - prefix[at]) * inverse[at] + (inside - at).astype(np.uint64))

    gram_end, gram = runs(gram_words)
    window_end, window = runs(min_words)
    begin = np.flatnonzero((window_end <= n) & (words > 0))
    value = np.where((words > 0) & (gram_end <= n), gram, np.uint64(2**64 - 1))
    # grams end the later the later they begin, up to the next text
    reach = np.maximum.accumulate(np.where(gram_end <= n, gram_end, 0))
    last = np.searchsorted(reach, window_end[begin], side="right") - 1
    chosen = _last_smallest(value, begin, np.minimum(last, window_end[begin] - 1))
    return window[begin], chosen, gram[chosen]


def _index(docs: DataFrame) -> DataFrame:
    """Lines, word counts and fingerprints (gram, line, hashes of the windows that select it) of each row."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            hashes, words, first = line_table(b.column("text"))
            window, chosen, gram = fingerprints(hashes, words, first)
            order = np.argsort(chosen, kind="stable")
            places, begin = np.unique(chosen[order], return_index=True)
            windows = pa.ListArray.from_arrays(pa.array(np.append(begin, len(order)).astype(np.int32)), pa.array(window[order].view(np.int64)))
            owner = np.searchsorted(first, places, side="right") - 1
            marks = pa.StructArray.from_arrays([pa.array(gram[order][begin].view(np.int64)), pa.array((places - first[owner]).astype(np.int32)), windows], names=["gram", "line", "windows"])
            off = pa.array(first.astype(np.int32))
            mark_off = pa.array(np.searchsorted(places, first).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("version"), pa.ListArray.from_arrays(off, pa.array(hashes.view(np.int64))), pa.ListArray.from_arrays(off, pa.array(words.astype(np.int32))), pa.ListArray.from_arrays(mark_off, marks)],
                names=["doc_id", "version", "lines", "words", "marks"],
            )

    return docs.select("doc_id", "version", "text").mapInArrow(apply, LINES)


def _extend(matches: DataFrame, min_words: int) -> DataFrame:
    """Repeated runs (first, stop) of rows with stretches of lines of both sides and the anchored positions.

    ``cut`` marks a run that reaches the end of a stretch and may go on behind it.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in range(b.num_rows):
                row = {c: b.column(c)[r] for c in b.schema.names}
                x, y = (np.asarray(row[c].values) for c in ("lines", "other_lines"))
                words = np.asarray(row["words"].values)
                base, other_base, n_lines, n_other = (row[c].as_py() for c in ("base", "other_base", "n_lines", "n_other"))
                key = [row[c].as_py() for c in PAIR]
                done: dict[int, int] = {}
                for pos in sorted(row["places"].as_py(), key=lambda p: (p["other_line"] - p["line"], p["line"])):
                    i, j = pos["line"] - base, pos["other_line"] - other_base
                    if done.get(j - i, -1) > i:
                        continue
                    n = min(len(x) - i, len(y) - j)
                    differ = np.flatnonzero(x[i : i + n] != y[j : j + n])
                    ahead = int(differ[0]) if len(differ) else n
                    n = min(i, j)
                    differ = np.flatnonzero(x[i - n : i] != y[j - n : j])
                    back = n - 1 - int(differ[-1]) if len(differ) else n
                    done[j - i] = i + ahead
                    # a run ends with either text, but not where only a stretch ends
                    begins = (i == back and base == 0) or (j == back and other_base == 0)
                    ends = (i + ahead == len(x) and base + len(x) == n_lines) or (j + ahead == len(y) and other_base + len(y) == n_other)
                    cut = (back == min(i, j) and not begins) or (ahead == min(len(x) - i, len(y) - j) and not ends)
                    if cut or words[i - back : i + ahead].sum() >= min_words:
                        out.append((*key, base + i - back, base + i + ahead, cut))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*PAIR, "first", "stop", "cut"])

    return matches.mapInArrow(apply, "doc_id long, version long, other long, other_version long, first int, stop int, cut boolean")


def _stretches(places: DataFrame, index: DataFrame, reach: int) -> DataFrame:
    """``places`` with the lines of both documents around them, ``reach`` lines to either side."""

    def around(rows: DataFrame, lines: DataFrame, key: list[str], at: str, prefix: str, *more: str) -> DataFrame:
        low = F.greatest(F.array_min(F.transform("places", lambda p: p[at])) - reach, F.lit(0))
        high = F.array_max(F.transform("places", lambda p: p[at])) + reach + 1
        found = rows.join(lines, key).withColumns({"low": low, "high": high})
        cut = lambda c: F.slice(c, F.col("low") + 1, F.col("high") - F.col("low"))
        return found.select(*PAIR, "places", *more, cut("lines").alias(f"{prefix}lines"), *([cut("words").alias("words")] if not prefix else []), F.col("low").alias(f"{prefix}base"), F.size("lines").alias(f"n_{prefix.rstrip('_') or 'lines'}"))

    theirs = index.select(F.col("doc_id").alias("other"), F.col("version").alias("other_version"), "lines")
    both = around(places, theirs, ["other", "other_version"], "other_line", "other_")
    return around(both, index.select("doc_id", "version", "lines", "words"), ["doc_id", "version"], "line", "", "other_lines", "other_base", "n_other")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """Later runs of lines to delete: ``doc_id``, ``version`` (a hash of the text), ``runs`` of (first, stop) line numbers.

    ``docs`` has ``doc_id``, ``version`` and ``text``.  Places are ordered by id, version and line.
    """
    index = store(_index(docs), "lines")
    marks = index.select("doc_id", "version", F.explode("marks").alias("m")).select("doc_id", "version", "m.gram", "m.line", "m.windows")
    again = store(marks.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    met = marks.join(checked_broadcast(again), "gram").select("doc_id", "version", "line", F.explode("windows").alias("window"))
    met = store(met.distinct(), "windows")
    place = F.struct("doc_id", "version", "line")
    first = store(met.groupBy("window").agg(F.min(place).alias("at"), F.count("*").alias("n")).where("n > 1").select("window", "at"), "anchors")
    later = met.join(first, "window").where(place > F.col("at"))
    places = later.groupBy("doc_id", "version", F.col("at.doc_id").alias("other"), F.col("at.version").alias("other_version")).agg(F.collect_set(F.struct("line", F.col("at.line").alias("other_line"))).alias("places"))
    todo = store(places, "places")
    # only documents that take part in a match are looked at again; rows equal in id and text are one
    parts = todo.select("doc_id", "version").unionAll(todo.select("other", "other_version")).distinct()
    lines = store(index.select("doc_id", "version", "lines", "words").join(parts, ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id", "version"]), "matched")
    found, reach = [], REACH
    while True:
        runs = store(_extend(_stretches(todo, lines, reach), MIN_WORDS), "extended")
        found.append(runs.where("NOT cut"))
        rest = runs.where("cut").select(*PAIR).distinct()
        if rest.isEmpty():
            break
        todo, reach = store(todo.join(rest, PAIR, "left_semi"), "places"), reach * REACH_STEP
    runs = reduce(DataFrame.unionAll, found)
    return store(runs.groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "stop")).alias("runs")), "runs")


def _marked(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` whole as ``row``, with its key, its text and the runs to delete; so no column of the input can clash."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("version", F.xxhash64("text"))
    runs = repeated_runs(rows.where("doc_id IS NOT NULL AND length(text) > 0").select("doc_id", "version", "text"))
    rows = rows.join(checked_broadcast(runs), ["doc_id", "version"], "left")
    pieces = F.split("text", "\n", -1)
    inside = lambda i: F.exists("runs", lambda r: (r["first"] <= i) & (i < r["stop"]))
    cut = F.array_join(F.filter(pieces, lambda _, i: ~inside(i)), "\n")
    rows = rows.withColumn("n_lines", F.when(F.length("text") > 0, F.size(pieces)).otherwise(F.lit(0)).cast("long"))
    gone = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["stop"] - 1)))))
    rows = rows.withColumn("n_removed", F.when(F.col("runs").isNull(), 0).otherwise(gone).cast("long"))
    return rows.withColumn("text", F.when(F.col("runs").isNull(), F.col("text")).otherwise(cut))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with later repeated runs removed from ``text``, plus ``n_lines`` and ``n_removed``.

    Lines are the pieces between newlines, compared whole; a run counts from
    MIN_WORDS words on, within one document or across several, and its first place, by
    id and line, stays.  Null and empty texts come back as they are, an empty table as an
    empty one.  Rows equal in id and text are one document and are changed alike; rows with
    a null id keep their text.  A text that repeats entirely becomes empty.  Columns of the
    input stay, whatever their names, but for ``n_lines`` and ``n_removed``, which are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    done = _marked(docs)
    return done.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names], "n_lines", "n_removed")


def strip(docs: DataFrame) -> DataFrame:
    """``docs`` in its own columns, texts without repeated runs; a text left without a word is dropped if lines were removed from it.

    Nulls, empty texts and repeated rows are treated as in ``dedup``; every column keeps its
    values, whatever its name, but for ``text`` and ``n_chars``, which is counted anew where lines went.
    """
    done = _marked(docs)
    done = done.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    columns = []
    for c in docs.columns:
        given = F.col("row").getField(c)
        if c == "text":
            given = F.col("text")
        elif c == "n_chars":
            given = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(given)
        columns.append(given.alias(c))
    return done.select(*columns)
