"""Harmonic packing of documents into fixed-length training sequences.

Classes are reciprocals of the capacity: class k has places of floor(capacity / k) tokens
and puts k pieces in a sequence.  A document fills whole sequences first; its rest
goes, in as few pieces as padding allows, to the smallest classes that hold them.  Workers
number their own pieces in each class; sums over the workers' counts turn these numbers
into sequences without moving a token, and only the few pieces of one sequence are added up
for their offsets.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.byte_bpe import codec
from docloom.llm.common import slices, store

CAPACITY = 2048
#: Tokens of padding that are worth one more piece, and the least tokens of a piece that is cut off.
PIECE, LEAST_CUT = 12, 32


@lru_cache(maxsize=4)
def class_plans(capacity: int = CAPACITY) -> list[list[tuple[int, int]]]:
    """For each rest below ``capacity`` its pieces as (length, places): the least padding, with PIECE tokens for each further piece.

    All pieces but the last fill their places; the last one goes to the smallest class that holds it.
    """
    sizes = sorted({capacity // k for k in range(1, capacity + 1)})
    holds = [next(s for s in sizes if s >= r) for r in range(capacity)]
    cost, plans = [0] * capacity, [[] for _ in range(capacity)]
    for r in range(1, capacity):
        cost[r], plans[r] = holds[r] - r, [(r, holds[r])]
        for s in sizes:
            if LEAST_CUT <= s <= r - LEAST_CUT and cost[r - s] + PIECE < cost[r]:
                cost[r], plans[r] = cost[r - s] + PIECE, [(s, s), *plans[r - s]]
    return plans


def pack(docs: DataFrame, tokens: Callable[[list[str | None]], list[np.ndarray]], *, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and, on request, ``ids``.

    ``tokens`` turns texts into id arrays inside the tasks.  Each id of a document lies
    in exactly one piece; a document without ids has no piece.  Places in a sequence
    run gapless from 0, padding stands at its end, and only the last sequence of each class
    can have fewer pieces than the others.  Null texts go to ``tokens`` as None; ids may be
    null or repeated, each row is packed.  An empty table gives no row; other columns of the
    input are not looked at.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        worker = context.partitionId() if context else 0
        next_in: dict[int, int] = {}
        plans = class_plans(capacity)
        for b in slices(batches, "text"):
            owner, start, length, crc, whole, size, number, ids = [], [], [], [], [], [], [], []
            for row, own in enumerate(tokens(b.column("text").to_pylist())):
                raw = own.astype("<u4").tobytes()
                at = 0
                for n, places in [(capacity, capacity)] * (len(own) // capacity) + plans[len(own) % capacity]:
                    piece = raw[4 * at : 4 * (at + n)]
                    owner.append(row)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(piece))
                    whole.append(len(own))
                    size.append(places)
                    number.append(next_in.get(places, 0))
                    next_in[places] = number[-1] + 1
                    at += n
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").tolist())
            columns = [b.column("doc_id").take(pa.array(owner, pa.int64())), *[pa.array(c, pa.int64()) for c in (start, length, crc, whole, size)], pa.array([worker] * len(owner), pa.int32()), pa.array(number, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.list_(pa.int64()))] if with_ids else [])], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", "worker", "number", *(["ids"] if with_ids else [])]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, size long, worker int, number long" + (", ids array<long>" if with_ids else "")
    # numbers are made once and stored, so a lost executor cannot renumber them
    pieces = store(rows.mapInArrow(cut, schema), "pieces")

    counts = pieces.groupBy("size", "worker").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)))
    shifts = store(shifts, "shifts")
    # at most `capacity` classes exist, so their table has a fixed bound
    bins = shifts.groupBy("size").agg(F.sum("n").alias("pieces")).withColumn("bins", F.ceil(F.col("pieces") / F.floor(F.lit(capacity) / F.col("size"))))
    first, total = {}, 0
    for row in sorted(bins.collect(), key=lambda r: -r.size):
        first[row.size] = total
        total += row.bins
    base = F.create_map(*[F.lit(x).cast("long") for kv in first.items() for x in kv]) if first else F.create_map().cast("map<bigint,bigint>")
    per_bin = F.floor(F.lit(capacity) / F.col("size")).cast("long")
    placed = pieces.join(shifts.select("size", "worker", "shift"), ["size", "worker"])
    index = F.col("number") + F.col("shift")
    placed = placed.withColumn("sequence_id", base[F.col("size")] + F.floor(index / per_bin).cast("long")).withColumn("place", F.pmod(index, per_bin))
    # a sequence has at most capacity / size pieces
    ahead = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))


def with_end(vocabulary: str, end: int = 1) -> Callable[[list[str | None]], list[np.ndarray]]:
    """Texts to ids as the tokenizers library gives them (special strings included), each followed by the id ``end``."""

    def tokens(texts: list[str | None]) -> list[np.ndarray]:
        return [np.append(ids, np.int32(end)) for ids in codec(vocabulary, True).encode(texts)]

    return tokens
