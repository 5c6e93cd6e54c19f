"""Near-duplicate documents by MinHash.

1. Each text becomes a set of word shingles, and the set a signature: the minima of
   many universal hashes, cut into bands.  Equal sets, told by 128 bits, collapse to one node.
2. Nodes that agree on a band share a bucket.  In each bucket the member
   that meets most others over all bands is the hub; every member is held against the
   hub it shares most bands with: signature first, then the full sets.
3. Components come from alternating large-star and small-star.
4. Buckets whose members still lie in several components are finished exactly: the
   members outside the hub's component are held against the others by signature, in blocks,
   each pair in the first band it shares only.  Sets are fetched for the pairs whose
   signatures agree enough, or, where these are more than a block has members, for the block.
5. Components again over what was found.

So a group of n copies costs about n comparisons, no pair is left out, and nothing
is gathered by group in one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import LOWER, checked_broadcast, mix, range_hashes, slices, store, utf8, words_of
from docloom.llm.components import components

#: A pair at the wanted similarity shares no band at most so often: once in 8 million times.
MISSED = 1.25e-7
#: Members of a bucket that are compared in one block.
BLOCK = 256


@dataclass(frozen=True)
class Scheme:
    """``bands`` of ``rows`` minima each, and the share of equal minima below which a pair is dropped before its sets are compared."""

    bands: int
    rows: int
    least: float

    def __post_init__(self) -> None:
        rng = np.random.Generator(np.random.PCG64(7919))
        a = rng.integers(0, 2**63, self.bands * self.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, self.bands * self.rows, dtype=np.uint64)
        band = rng.integers(0, 2**63, self.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for name, value in (("a", a), ("b", b), ("band", band)):
            object.__setattr__(self, name, value)


def scheme(percent: int) -> Scheme:
    """The scheme for a similarity: 5 minima a band from 0.8 up, 3 from 0.5 up, else 2; a pair at it is 7 deviations above ``least``."""
    p = percent / 100
    if percent == 80:
        return Scheme(40, 5, 0.6)
    rows = 5 if percent > 80 else 3 if percent >= 50 else 2
    bands = 1 if percent >= 100 else math.ceil(math.log(MISSED) / math.log(1 - p**rows))
    return Scheme(bands, rows, max(0.0, p - 7 * math.sqrt(p * (1 - p) / (bands * rows))))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, with A-Z lower-cased.

    A text with fewer words than ``width`` has its whole word sequence as one shingle,
    one without words none.
    """
    data, off = utf8(texts)
    starts, ends, first, last = words_of(data, off)
    words = range_hashes(data, starts, ends, LOWER)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0xA0761D6478BD642F) + words[k : k + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in words[a:b]:
                h = mix(h * np.uint64(0xE7037ED1A0B428DB) + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray, by: Scheme) -> np.ndarray:
    """The minima of all hashes over one set, as 32-bit numbers."""
    low = np.full(len(by.a), np.uint64(2**64 - 1))
    for at in range(0, len(s), 1024):
        np.minimum(low, (s[at : at + 1024, None] * by.a + by.b).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def bands(sig: np.ndarray, by: Scheme) -> np.ndarray:
    rows = sig.reshape(by.bands, by.rows).astype(np.uint64)
    return mix((rows * by.band).sum(axis=1, dtype=np.uint64) + np.arange(by.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a digest of a whole sorted set, as two longs."""
    a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
    return int(a), int(b)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))


def _sketch(docs: DataFrame, width: int, by: Scheme, key_bits: int) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = shingle_sets(b.column("text"), width)
            n = pa.array([len(s) for s in sets], pa.int64())
            keys = [set_key(s) if len(s) else (None, None) for s in sets]
            node = pa.array([a if a is None or key_bits == 64 else a % 2**key_bits for a, _ in keys], pa.int64())
            check = pa.array([c for _, c in keys], pa.int64())
            marks = np.stack([bands(signature(s, by), by) if len(s) else np.zeros(by.bands, np.int64) for s in sets])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * by.bands), pa.array(marks.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("version"), n, node, check, lists], names=["doc_id", "version", "n_shingles", "node", "check", "bands"])

    return _told_apart(store(_rows(docs).mapInArrow(apply, "doc_id long, version long, n_shingles long, node long, check long, bands array<long>"), "sketch"))


def _told_apart(sketch: DataFrame) -> DataFrame:
    """``sketch`` with another node for a set whose first 64 bits are those of a different set."""
    sets = sketch.where("node IS NOT NULL").select("node", "check").distinct()
    clash = store(sets.groupBy("node").agg(F.min("check").alias("main"), F.count("*").alias("n")).where("n > 1").select("node", "main"), "clashes")
    if clash.isEmpty():
        return sketch
    moved = F.when(F.col("main") != F.col("check"), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return store(sketch.join(clash, "node", "left").withColumn("node", F.coalesce(moved, "node")).drop("main"), "sketch")


def _full(rows: DataFrame, width: int, by: Scheme) -> DataFrame:
    """``node``, signature and sorted set of each row (node, text), as bytes."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = shingle_sets(b.column("text"), width)
            sigs = [signature(s, by) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([s.tobytes() for s in sigs], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "sig", "items"])

    return rows.select("node", "text").mapInArrow(apply, "node long, sig binary, items binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _verify(pairs: DataFrame, full: DataFrame, percent: int, by: Scheme) -> DataFrame:
    """The rows of ``pairs`` (a, b and other longs) whose sets are similar."""
    names = pairs.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                hit = []
                for sa, ia, sb, ib in zip(*[part.column(c).to_pylist() for c in ("sig_a", "items_a", "sig_b", "items_b")], strict=True):
                    agree = (np.frombuffer(sa, np.uint32) == np.frombuffer(sb, np.uint32)).mean()
                    hit.append(bool(agree >= by.least and similar(np.frombuffer(ia, np.uint64), np.frombuffer(ib, np.uint64), percent)))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names], names=names).filter(pa.array(hit, pa.bool_()))

    side = lambda c: full.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("items").alias(f"items_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(apply, ", ".join(f"{c} long" for c in names))


def _likely(table: pa.Table, by: Scheme) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of side 0 with the rows of side 1 that it has to be held against, those that agree most first."""
    side, comp = (table.column(c).to_numpy() for c in ("side", "comp"))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return
    sig = np.stack([np.frombuffer(x, np.uint32) for x in table.column("sig").to_pylist()])
    mark = np.stack([bands(x, by) for x in sig])
    band = int(np.flatnonzero(mark[left[0]] == table.column("bucket")[0].as_py())[0])
    sr, mr = sig[right], mark[right]
    for i in left:
        shared = mr[:, : band + 1] == mark[i][: band + 1]
        agree = (sr == sig[i]).mean(axis=1)
        todo = np.flatnonzero(shared[:, band] & ~shared[:, :band].any(axis=1) & (agree >= by.least) & (comp[right] != comp[i]))
        yield i, right[todo[np.argsort(-agree[todo], kind="stable")]]


BLOCK_KEY = ["bucket", "block", "other"]


def _candidates(members: DataFrame, by: Scheme) -> DataFrame:
    """Pairs of nodes in different components that may be similar: ``a``, ``b``, ``comp_a``, ``comp_b``.

    ``members`` has (bucket, block, other, side, node, comp, sig): in each group of bucket,
    block and other block, rows of side 0 are held against those of side 1.  A group with
    more such pairs than half its rows gives one row with its key and no pair.
    """

    def apply(table: pa.Table) -> pa.Table:
        key = [table.column(c)[0].as_py() for c in BLOCK_KEY]
        node, comp = (table.column(c).to_numpy() for c in ("node", "comp"))
        a: list[int] = []
        b: list[int] = []
        for i, others in _likely(table, by):
            a += [i] * len(others)
            b += others.tolist()
            if 2 * len(a) > len(node):
                return pa.table({**{c: [v] for c, v in zip(BLOCK_KEY, key, strict=True)}, **{c: pa.array([None], pa.int64()) for c in ("a", "b", "comp_a", "comp_b")}})
        return pa.table({**{c: pa.array([v] * len(a), pa.int64()) for c, v in zip(BLOCK_KEY, key, strict=True)}, "a": node[a], "b": node[b], "comp_a": comp[a], "comp_b": comp[b]})

    keyed = members.withColumns({c: F.col(c).cast("long") for c in BLOCK_KEY})
    return keyed.groupBy(*BLOCK_KEY).applyInArrow(apply, "bucket long, block long, other long, a long, b long, comp_a long, comp_b long")


def _dense(members: DataFrame, percent: int, by: Scheme) -> DataFrame:
    """Linked components of whole blocks, whose rows have their sets as ``items``; a row looks for one link to each component."""

    def apply(table: pa.Table) -> pa.Table:
        comp, items = table.column("comp").to_numpy(), table.column("items").to_pylist()
        found: set[tuple[int, int]] = set()
        for i, others in _likely(table, by):
            met = set()
            own = np.frombuffer(items[i], np.uint64)
            for j in others:
                if comp[j] not in met and similar(own, np.frombuffer(items[j], np.uint64), percent):
                    met.add(comp[j])
            found |= {(int(comp[i]), int(c)) for c in met}
        return pa.table({"comp_a": pa.array([a for a, _ in found], pa.int64()), "comp_b": pa.array([b for _, b in found], pa.int64())})

    return members.groupBy(*BLOCK_KEY).applyInArrow(apply, "comp_a long, comp_b long")


def _blocks(members: DataFrame, home: DataFrame, hubs: DataFrame, full: DataFrame) -> DataFrame | None:
    """The rows of unsettled buckets in blocks, for ``_candidates``; None if every bucket lies in one component."""
    placed = store(members.join(home, "node").select("bucket", "n", "node", "comp"), "placed")
    unsettled = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    main = hubs.join(home, hubs["hub"] == home["node"]).select("bucket", F.col("comp").alias("main"))
    unsettled = store(unsettled.join(main, "bucket"), "unsettled")
    if unsettled.isEmpty():
        return None
    todo = placed.join(unsettled, "bucket")
    todo = store(todo.select("bucket", "n", "node", "comp", (F.col("comp") != F.col("main")).alias("stray")), "todo")
    # strays and members are blocked each by their own number; every stray block meets every member block
    split = todo.where("stray").groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("stray_blocks"))
    todo = todo.join(store(split, "split"), "bucket").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = todo.where("stray").select("bucket", part("stray_blocks").alias("block"), every("blocks").alias("other"), F.lit(0).alias("side"), "node", "comp")
    right = todo.select("bucket", every("stray_blocks").alias("block"), part("blocks").alias("other"), F.lit(1).alias("side"), "node", "comp")
    return left.unionAll(right).join(full.select("node", "sig"), "node").select("bucket", "block", "other", "side", "node", "comp", "sig")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when the Jaccard similarity of their shingle sets is at least
    ``percent`` in a hundred; ``component_id`` is the smallest id reachable and ``kept``
    marks its bearer.  Null, empty and blank texts have an empty set and link with
    nothing.  Rows that share an id are judged each by its own text.  Rows with a null id
    link with nothing, have a null component and are kept.  An empty table gives no row,
    and other columns of the input are not looked at.
    """
    return _near_duplicates(docs, width, percent).drop("version")


def _near_duplicates(docs: DataFrame, width: int, percent: int, key_bits: int = 64) -> DataFrame:
    """The same with ``version``, a hash of the row's text.  Nodes of the graph are distinct sets; tests narrow their keys."""
    by = scheme(percent)
    sketch = _sketch(docs, width, by, key_bits)
    valid = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = store(valid.groupBy("node").agg(F.min(F.struct("doc_id", "version")).alias("at")), "reps")

    chosen = (F.col("doc_id") == F.col("at.doc_id")) & (F.col("version") == F.col("at.version"))
    marked = valid.join(reps, "node").where(chosen).select("node", F.explode("bands").alias("bucket"))
    sizes = store(marked.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = store(marked.join(sizes, "bucket").distinct(), "members")
    busy = members.groupBy("node").agg(F.sum("n").alias("met"))
    hubs = store(members.join(busy, "node").groupBy("bucket").agg(F.max_by("node", F.struct("met", "node")).alias("hub")), "hubs")
    wanted = members.join(hubs, "bucket").where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("n"))
    pairs = store(wanted.groupBy("node").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub")), "pairs")

    texts = members.select("node").distinct().join(reps, "node").select(F.col("at.doc_id").alias("doc_id"), F.col("at.version").alias("version"), "node")
    texts = store(texts, "texts")
    full = store(_full(_rows(docs).join(checked_broadcast(texts), ["doc_id", "version"]), width, by).dropDuplicates(["node"]), "sets")
    links = store(_verify(pairs.select(F.col("node").alias("a"), F.col("hub").alias("b")), full, percent, by), "links")
    comp = store(components(links), "components")
    home = store(members.select("node").distinct().join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("comp")), "home")

    # a bucket is unsettled while its members lie in several components
    work = _blocks(members, home, hubs, full)
    if work is not None:
        tried = store(_candidates(work, by), "candidates")
        links = store(_verify(tried.where("a IS NOT NULL").select("a", "b", "comp_a", "comp_b").distinct(), full, percent, by), "links")
        whole = checked_broadcast(store(tried.where("a IS NULL").select(*BLOCK_KEY), "dense"))
        dense = work.join(whole, BLOCK_KEY, "left_semi").join(full.select("node", "items"), "node")
        links = links.select("comp_a", "comp_b").unionAll(store(_dense(dense, percent, by), "links"))
        merged = store(components(links), "components").select(F.col("node").alias("comp"), F.col("component").alias("final"))
        home = store(home.join(merged, "comp", "left").select("node", F.coalesce("final", "comp").alias("comp")), "home")

    classes = store(reps.join(home, "node", "left").select("node", "at", F.coalesce("comp", "node").alias("class")), "classes")
    # a class is named by its smallest id
    names = store(classes.groupBy("class").agg(F.min("at.doc_id").alias("first")), "names")
    where = store(classes.join(names, "class").select("node", "first"), "where")
    rows = sketch.select("doc_id", "version", "n_shingles", "node").join(where, "node", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("first", "doc_id"))
    return rows.select("doc_id", "version", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that bear the smallest id of their component, with all their columns, whatever these are called.

    Rows equal in id and text stay or go together; rows with a null id, and null, empty and blank texts, stay.
    """
    lost = store(_near_duplicates(docs, width, percent).where("NOT kept").select("doc_id", "version").distinct(), "lost")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("version"))
    kept = rows.join(checked_broadcast(lost), ["doc_id", "version"], "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
