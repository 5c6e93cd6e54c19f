"""Phrase collocations: counts of all frequent word sequences, and those whose parts meet far more often than by chance.

Texts are read three times: for words, for pairs and for three to five words.  Each block of
texts sorts its phrases and builds count automata of them (``transducer``), one for each prefix
range; those of the blocks of a task are joined as they come.
The automata of a range meet in one task, which sums up their weights.  A phrase can only be
as frequent as what it is made of, so sequences with a rare word or pair are left out early;
that filter has a fixed greatest size and lets some rare ones through, which the sums then
drop.  Counts of the parts of candidates come from composing automata of the parts with
those of the counts.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import transducer
from docloom.llm.common import mix, range_hashes, slices, store, utf8
from docloom.llm.transducer import Transducer

#: Words of the longest phrase.
LONGEST = 5
#: Bytes of text whose phrases are counted at once.
BLOCK = 2 << 20
#: Occurrences in the prefix range of one group, and prefix ranges at most; above that, ranges are cut by the second word.
SHARE, MOST_RANGES = 1 << 21, 1 << 16
#: Phrases that a task holds before it sends on their automata.
HELD = 1 << 20
#: Bits of the filter of frequent phrases for each of these, and at most (16 MB).
BITS_EACH, MOST_BITS = 16, 1 << 27
_BLANK, _CUT = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SEED = np.uint64(0xD6E8FEB86659FD93)


class Block:
    """The words of some texts: sorted distinct ones, a number for each occurrence, and which occurrences follow each other in a piece."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
        langs = batch.column(batch.schema.get_field_index("lang"))
        data = _FOLD[data]
        cut = _CUT[data]
        word = ~(cut | _BLANK[data])
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        begin[edge] |= word[edge]
        end[edge - 1] |= word[edge - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        piece = np.cumsum(cut, dtype=np.int32)[starts] if len(data) else np.zeros(0, np.int32)
        doc = np.searchsorted(offsets, starts, "right") - 1
        lengths = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=lengths[1:])
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(lengths), pa.py_buffer(data[word])) if len(starts) else pa.array([], pa.string())
        self.labels, self.codes = transducer.sorted_labels(words)
        self.lang_names, rank = transducer.sorted_labels(langs)
        self.langs = rank[doc]
        self.joined = np.zeros(len(starts), bool)
        self.joined[:-1] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
        raw, off = utf8(self.labels)
        self.hashes = range_hashes(raw, off[:-1], off[1:])
        raw, off = utf8(self.lang_names)
        self.lang_hashes = range_hashes(raw, off[:-1], off[1:])

    def words(self) -> pa.RecordBatch:
        """``lang``, ``word``, ``n``: each word's occurrences."""
        key, n = np.unique(self.langs * len(self.labels) + self.codes, return_counts=True)
        lang, code = key // max(len(self.labels), 1), key % max(len(self.labels), 1)
        return pa.RecordBatch.from_arrays([self.lang_names.take(pa.array(lang)), self.labels.take(pa.array(code)), pa.array(n)], names=["lang", "word", "n"])

    def hashed(self, rows: int) -> np.ndarray:
        """Of each occurrence, the hash of the ``rows`` words from there on, as if all followed each other."""
        out = mix(self.lang_hashes[self.langs] ^ _SEED)
        for k in range(rows):
            nxt = np.zeros(len(out), np.uint64)
            nxt[: len(out) - k] = self.hashes[self.codes[k:]]
            out = mix(out * _SEED + nxt)
        return out

    def phrases(self, frequent: Filter, sizes: tuple[int, int]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """``lang``, sorted rows of codes and their counts, for phrases of the given numbers of words whose parts pass the filter."""
        n, width = len(self.codes), sizes[1]
        ok = frequent.has(self.hashed(frequent.words))
        for k in range(frequent.words - 1):
            ok[: n - k] &= self.joined[k:]
            ok[n - k :] = False
        alive, ids = ok.copy(), np.unique(self.codes + self.langs * len(self.labels), return_inverse=True)[1]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(2, width + 1):
            # k words from i on: k - 1 from i on, joined to what the filter holds up to there
            last = k - frequent.words
            if n <= last:
                break
            if last > 0:
                alive[: n - 1] &= self.joined[: n - 1]
                alive[: n - last] &= ok[last:] & (self.joined[k - 2 : n - last + k - 2] if frequent.words == 1 else True)
                alive[n - last :] = False
            at = np.flatnonzero(alive[: n - k + 1]) if n >= k else np.zeros(0, np.int64)
            _, head, inverse, count = np.unique(ids[at] * len(self.labels) + self.codes[at + k - 1], return_index=True, return_inverse=True, return_counts=True)
            ids[at] = inverse
            if k >= sizes[0] and len(at):
                rows = np.full((len(head), width), -1, np.int32)
                rows[:, :k] = self.codes[at[head][:, None] + np.arange(k)]
                found.append((np.column_stack([self.langs[at[head]].astype(np.int32), rows]), count))
        if not found:
            return
        rows, counts = np.vstack([r for r, _ in found]), np.concatenate([c for _, c in found])
        order = np.lexsort(rows.T[::-1])
        rows, counts = rows[order], counts[order]
        for code in np.unique(rows[:, 0]):
            a, b = np.searchsorted(rows[:, 0], [code, code + 1])
            yield self.lang_names[int(code)].as_py(), rows[a:b, 1:], counts[a:b]


class Filter:
    """A bitmap that knows all frequent phrases of some number of words, by hash; at most 16 MB, with some others among them."""

    def __init__(self, words: int, bits: int, found: list[tuple[int, bytes]]) -> None:
        self.words, self.bits, self.map = words, bits, np.zeros(bits // 8, np.uint8)
        for segment, part in found:
            at = segment * len(part)
            self.map[at : at + len(part)] |= np.frombuffer(part, np.uint8)

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
        return [(mix(hashes + np.uint64(i << 40)) & np.uint64(bits - 1)).astype(np.int64) for i in range(3)]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        ok = np.ones(len(hashes), bool)
        for p in self.places(hashes, self.bits):
            ok &= (self.map[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
        return ok


def _hash_of(lang: str, phrases: list[list[str]]) -> np.ndarray:
    def one(values: list[str]) -> np.ndarray:
        raw, off = utf8(pa.array(values, pa.string()))
        return range_hashes(raw, off[:-1], off[1:])

    out = np.repeat(mix(one([lang]) ^ _SEED), len(phrases))
    for k in range(len(phrases[0]) if phrases else 0):
        out = mix(out * _SEED + one([p[k] for p in phrases]))
    return out


def _filter(phrases: DataFrame, words: int, segment_bits: int = 1 << 15) -> Filter:
    """The filter of ``phrases`` (lang, phrase), put together from bitmaps of equal segments."""
    count = phrases.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << max(BITS_EACH * count - 1, 1).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, phrase = np.array(b.column("lang").to_pylist(), object), b.column("phrase").to_pylist()
            for one in dict.fromkeys(lang.tolist()):
                own = [phrase[i].split(" ") for i in np.flatnonzero(lang == one)]
                at = np.unique(np.concatenate(Filter.places(_hash_of(one, own), bits)))
                yield pa.RecordBatch.from_arrays([pa.array(at // segment_bits), pa.array(at % segment_bits)], names=["segment", "at"])

    def gather(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(segment_bits, np.uint8)
        for b in rows:
            held[b.column("at").to_numpy()] = 1
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([np.packbits(held, bitorder="little").tobytes()])], names=["segment", "part"])

    placed = phrases.select("lang", "phrase").mapInArrow(place, "segment long, at long").distinct()
    found = placed.groupBy("segment").applyInArrow(gather, "segment long, part binary").collect()
    return Filter(words, bits, [(r.segment, r.part) for r in found])


class Ranges:
    """Prefix ranges: (lang, first word) of each range's beginning, and the slices by second word that it is cut into."""

    def __init__(self, bounds: list[tuple[str, str]], cuts: list[int]) -> None:
        self.bounds = [(a.encode(), b.encode()) for a, b in bounds]
        self.cuts = cuts

    def of(self, lang: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = np.array([max(bisect.bisect_right(self.bounds, (lang.encode(), w.encode())) - 1, 0) for w in words], np.int64)
        return at, np.array(self.cuts, np.int64)[at]


def _ranges(words: DataFrame, total: int) -> Ranges:
    """Cuts of the sorted frequent ``words`` (stored: lang, phrase, f) into ranges of about equal occurrences.

    Each sorted partition is summed up by itself; the sums of the partitions before give
    each word its place among all occurrences, so nothing is sorted in one task.
    """
    step = max(SHARE, -(-total // MOST_RANGES))
    placed = store(words.repartitionByRange("lang", "phrase").withColumn("part", F.spark_partition_id()), "placed")
    sums = placed.groupBy("part").agg(F.sum("f").alias("held"))
    before = sums.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"))
    run = F.sum("f").over(Window.partitionBy("part").orderBy("lang", "phrase"))
    at = placed.join(F.broadcast(before), "part").select("lang", "phrase", "f", F.floor((F.col("before") + run - F.col("f")) / step).alias("r"))
    rows = at.groupBy("lang", "r").agg(F.min("phrase").alias("phrase"), F.sum("f").alias("f")).collect()
    rows.sort(key=lambda r: (r.lang.encode(), r.phrase.encode()))
    return Ranges([(r.lang, r.phrase) for r in rows], [max(1, -(-r.f // SHARE)) for r in rows])


def _cut(lang: str, labels: pa.StringArray, rows: np.ndarray, counts: np.ndarray, ranges: Ranges) -> Iterator[tuple[tuple[str, int, int], tuple]]:
    """Sorted phrases by prefix range and slice: the key and (labels, rows, counts), still sorted."""
    heads = np.unique(rows[:, 0])
    at, cuts = ranges.of(lang, labels.take(pa.array(heads)).to_pylist())
    place = np.searchsorted(heads, rows[:, 0])
    raw, off = utf8(labels)
    second = range_hashes(raw, off[:-1], off[1:])
    slices_ = np.zeros(len(rows), np.int64)
    if rows.shape[1] > 1:
        two = rows[:, 1] >= 0
        slices_[two] = (mix(second[rows[two, 1]]) % cuts[place][two].astype(np.uint64)).astype(np.int64)
    order = np.lexsort((slices_, at[place]))
    keys = np.column_stack([at[place], slices_])[order]
    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
    for a, b in zip(new, [*new[1:], len(rows)], strict=True):
        part = order[a:b]  # stable, so the rows stay sorted
        yield (lang, int(keys[a, 0]), int(keys[a, 1])), (*transducer.trimmed(labels, rows[part]), counts[part])


def _by_range(lang: str, labels: pa.StringArray, rows: np.ndarray, counts: np.ndarray, ranges: Ranges) -> Iterator[tuple[str, int, int, Transducer]]:
    """Automata of sorted phrases, one for each prefix range and slice."""
    for key, piece in _cut(lang, labels, rows, counts, ranges):
        yield *key, transducer.build(*piece)


def _rows(parts: list[tuple[str, int, int, Transducer]]) -> pa.RecordBatch:
    """Automata as rows: their range and the columns of ``transducer.SCHEMA``."""
    labels = [p[3].labels for p in parts]
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in labels], out=off[1:])
    numbers = [p[3].columns()[1:] for p in parts]
    columns = [pa.ListArray.from_arrays(pa.array(off), pa.concat_arrays(labels).cast(pa.string()) if parts else pa.array([], pa.string()))]
    columns += [pa.array([n[i] for n in numbers], pa.binary()) for i in range(len(transducer.COLUMNS) - 1)]
    head = [pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.int64()), pa.array([p[2] for p in parts], pa.int64())]
    return pa.RecordBatch.from_arrays([*head, *columns], names=["lang", "range", "slice", *transducer.COLUMNS])


_SHARDS = f"lang string, range long, slice long, {transducer.SCHEMA}"


def _shards(docs: DataFrame, frequent: Filter, sizes: tuple[int, int], ranges: Ranges) -> DataFrame:
    """The automata of each block of texts, by prefix range."""
    held = docs.sparkSession.sparkContext.broadcast((frequent, ranges))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, ranges = held.value
        waiting: dict[tuple[str, int, int], list[tuple]] = {}
        size = 0
        for b in slices(batches, "text", rows=1 << 16, size=BLOCK):
            own = Block(b)
            for lang, rows, counts in own.phrases(frequent, sizes):
                for key, piece in _cut(lang, own.labels, rows, counts, ranges):
                    waiting.setdefault(key, []).append(piece)
                    size += len(piece[2])
            if size > HELD:
                yield from _united(waiting)
                waiting, size = {}, 0
        yield from _united(waiting)

    return docs.mapInArrow(count, _SHARDS)


def _united(waiting: dict[tuple[str, int, int], list[tuple]]) -> Iterator[pa.RecordBatch]:
    """What the blocks of a task have counted so far, one automaton for each range and slice."""
    for key in list(waiting):
        yield _rows([(*key, transducer.add_up(waiting.pop(key)))])


def _unite(shards: DataFrame, least: int) -> DataFrame:
    """One automaton for each range and slice, with the sums of all shards, without phrases below ``least``."""

    def sum_up(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, waiting = None, []
        for b in batches:
            for i in range(b.num_rows):
                waiting += transducer.read(b.slice(i, 1))
                # a few shards at a time are spelled out; what is rare so far may become frequent, so nothing is dropped yet
                if sum(len(t.weights) for t in waiting) > max(HELD // 2, len(whole.weights) if whole else 0):
                    whole = transducer.union([*([whole] if whole else []), *waiting])
                    waiting = []
                    pa.default_memory_pool().release_unused()
        whole = transducer.union([*([whole] if whole else []), *waiting], least)
        yield _rows([(key[0].as_py(), key[1].as_py(), key[2].as_py(), whole)])

    return shards.groupBy("lang", "range", "slice").applyInArrow(sum_up, _SHARDS)


def _listed(automata: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``size`` and ``f`` of all phrases in the automata."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                texts, sizes, weights = transducer.read(b.slice(i, 1))[0].texts()
                yield pa.RecordBatch.from_arrays([pa.array([b.column("lang")[i].as_py()] * len(texts), pa.string()), pa.array(texts, pa.string()), pa.array(sizes.astype(np.int32)), pa.array(weights)], names=["lang", "phrase", "size", "f"])

    return automata.mapInArrow(spell, "lang string, phrase string, size int, f long")


def _parts_of(phrases: DataFrame) -> DataFrame:
    """Each cut of each phrase of two words or more: ``k`` and the words before and after it."""
    ws = F.split("phrase", " ")
    join = lambda a, n: F.array_join(F.slice(ws, a, n), " ")
    return phrases.where("size > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumns({"head": join(F.lit(1), F.col("k")), "rest": join(F.col("k") + 1, F.col("size") - F.col("k"))})


def _looked_up(parts: DataFrame, automata: DataFrame, ranges: Ranges) -> DataFrame:
    """``lang``, ``phrase``, ``f`` for distinct ``parts`` (lang, phrase): automata of these composed with those of the counts."""
    held = parts.sparkSession.sparkContext.broadcast(ranges)

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, phrase = np.array(b.column("lang").to_pylist(), object), b.column("phrase").to_pylist()
            for one in dict.fromkeys(lang.tolist()):
                asked = transducer.from_texts([phrase[i] for i in np.flatnonzero(lang == one)])
                rows, counts = asked.phrases()
                parts = list(_by_range(one, asked.labels, rows, counts, held.value))
                for i in range(0, len(parts), 64):
                    yield _rows(parts[i : i + 64])

    def answer(key: tuple, asked: pa.Table, counts: pa.Table) -> pa.Table:
        whole = transducer.union(transducer.read(counts))
        asked_all = transducer.union(transducer.read(asked))
        texts, _, _ = asked_all.texts()
        found = transducer.compose(asked_all, whole)
        return pa.table([pa.array([key[0].as_py()] * len(texts), pa.string()), pa.array(texts, pa.string()), pa.array(found)], names=["lang", "phrase", "f"])

    asked = parts.select("lang", "phrase").distinct().mapInArrow(shape, _SHARDS)
    groups = ["lang", "range", "slice"]
    return asked.groupBy(groups).cogroup(automata.groupBy(groups)).applyInArrow(answer, "lang string, phrase string, f long")


def counts(docs: DataFrame, least: int = 100, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, Ranges, DataFrame]:
    """(phrases, automata, ranges, totals): all phrases of 1 to 5 words with at least ``least`` occurrences.

    A null text is empty, a null lang is ``und``.  ``totals`` has ``lang`` and ``n``, all
    words.  Empty tables give empty frames.
    """
    read = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", rows=1 << 16, size=BLOCK):
            yield Block(b).words()

    every = store(read.mapInArrow(words, "lang string, word string, n long").groupBy("lang", F.col("word").alias("phrase")).agg(F.sum("n").alias("f")), "words")
    totals = store(every.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    one = store(every.where(F.col("f") >= least), "frequent")
    ranges = _ranges(one, one.agg(F.sum("f")).first()[0] or 0)
    held = one.sparkSession.sparkContext.broadcast(ranges)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, f = np.array(b.column("lang").to_pylist(), object), b.column("f").to_numpy()
            for name in dict.fromkeys(lang.tolist()):
                at = np.flatnonzero(lang == name)
                known = transducer.from_texts([b.column("phrase")[int(i)].as_py() for i in at], f[at])
                rows, weights = known.phrases()
                parts = list(_by_range(name, known.labels, rows, weights, held.value))
                for i in range(0, len(parts), 64):
                    yield _rows(parts[i : i + 64])

    two = store(_unite(_shards(read, _filter(one, 1), (2, 2), ranges), least), "pairs")
    more = _unite(_shards(read, _filter(_listed(two), 2), (3, LONGEST), ranges), least)
    automata = store(_unite(one.mapInArrow(single, _SHARDS).unionByName(two).unionByName(more), least), "automata")
    return store(_listed(automata), "phrases"), automata, ranges, totals


def collocations(docs: DataFrame, least: int = 100, best: int = 2000) -> DataFrame:
    """The ``best`` phrases of each lang: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase of 2 to 5 words is cut where its parts explain it best: the cut with the
    smallest ``floor(1000 * a * n / (l * r))``, the first of equal ones.  One that only
    occurs inside one longer phrase is left out.  Repeated rows count each time.
    """
    phrases, automata, ranges, totals = counts(docs, least)
    cuts = _parts_of(phrases)
    parts = cuts.select("lang", F.explode(F.array("head", "rest")).alias("phrase")).distinct()
    known = store(_looked_up(parts, automata, ranges), "parts")
    # with a superphrase as frequent, one word longer is enough: what lies between is as frequent too
    ws = F.split("phrase", " ")
    inner = phrases.where("size > 2").select("lang", "f", F.explode(F.array(F.array_join(F.slice(ws, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(ws, F.lit(2), F.col("size") - 1), " "))).alias("phrase")).distinct()
    exact = "decimal(38,0)"
    scored = (
        cuts.join(inner, ["lang", "phrase", "f"], "left_anti")
        .join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
        .join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
        .join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang")
        .withColumn("score", F.expr(f"CAST((CAST(1000 AS {exact}) * CAST(f AS {exact}) * CAST(n AS {exact})) div (CAST(l AS {exact}) * CAST(r AS {exact})) AS LONG)"))
        .groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "k", F.col("f").alias("a"), "l", "r", "n")).alias("cut"))
        .select("lang", "phrase", "cut.*")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within shares of a lang, so that a large one is not sorted in one task
    share = F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("share")
    local = scored.select("*", share).withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("place") <= best)
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


