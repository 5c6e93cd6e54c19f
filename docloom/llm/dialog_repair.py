"""Repair of the structure of conversations: the cheapest edits that make roles alternate, found chunk by chunk.

The roles of a conversation shall read ``(s?(ua)+)?`` by their initials.  A row is kept,
given the role that fits, or deleted, and rows are inserted; the least cost from each
place to the end, for each of four states, is a Viterbi recursion from the back.  A long
conversation is cut into chunks.  All start at once from a guessed vector of costs, and passes
follow in which only those chunks run again whose guess differs from their neighbour's
result by more than a constant.  Such differences vanish within a few rows of almost any
conversation (the recursion's rank converges to one), so few passes are needed; rows that
can only be repaired one by one, in chunk after chunk, need one pass for each such chunk.
The path forward is settled in the same way and takes the smallest letter of all cheapest edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import store

#: Costs of the edits, and what a truncated row adds if it stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Bits of places in one chunk: 65,536 rows of the order of all rows.
CHUNK_BITS = 16
_BLANKS = " \t\n\x0b\f\r"
#: States: nothing yet, after system, after user, after assistant; where a user's or assistant's row leads from each.
_NEXT, _ROLES = (2, 2, 3, 2), {2: "user", 3: "assistant"}
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Costs at the end of a conversation: what is missing is inserted.
_END = (0, 2 * INSERT, INSERT, 0)
#: Marks of a row: its role's initial and its fault, as one letter.
_SIGNS, _FAULTS = "suao", ("", "truncated", "blank", "duplicate")
_MARKS = {chr(65 + 4 * i + j): (s, f) for i, s in enumerate(_SIGNS) for j, f in enumerate(_FAULTS)}

Vector = tuple[int, ...]


@lru_cache(maxsize=1 << 16)
def step(after: Vector, mark: str) -> tuple[Vector, tuple[tuple[str, int], ...]]:
    """Costs before a row from those after it, less their minimum, and for each state the smallest letter of a cheapest edit and its state."""
    sign, fault = _MARKS[mark]
    stays, more = fault in ("", "truncated"), TRUNCATED if fault == "truncated" else 0
    ways: list[dict[str, tuple[int, int]]] = []
    for s in range(4):
        own = {"D": (DELETE + after[s], s)}
        if stays and (s, sign) in _KEPT:
            own["K"] = (more + after[_KEPT[s, sign]], _KEPT[s, sign])
        if stays:
            own["R"] = (REROLE + more + after[_NEXT[s]], _NEXT[s])
        ways.append(own)
    cost = [min(c for c, _ in own.values()) for own in ways]
    for _ in range(2):
        cost = [min(c, INSERT + cost[_NEXT[s]]) for s, c in enumerate(cost)]
    choice = []
    for s, own in enumerate(ways):
        own["I"] = (INSERT + cost[_NEXT[s]], _NEXT[s])
        letter = min(x for x, (c, _) in own.items() if c == cost[s])
        choice.append((letter, own[letter][1]))
    least = min(cost)
    return tuple(c - least for c in cost), tuple(choice)


def backward(marks: str, after: Vector) -> tuple[Vector, list]:
    """Costs before the first row, less their minimum, and the choices at each row."""
    choices = []
    for m in reversed(marks):
        after, own = step(after, m)
        choices.append(own)
    choices.reverse()
    return after, choices


def forward(choices: list, state: int) -> tuple[int, list[tuple[int, str, int]]]:
    """The state after the last row, and the edits: row, letter, state after it.  What is inserted after the last row is not among them."""
    edits = []
    for i, own in enumerate(choices):
        letter = "I"
        while letter == "I":
            letter, state = own[state]
            edits.append((i, letter, state))
    return state, edits


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` as a careless export leaves them, by a hash of conversation and turn: dropped, emptied, cut, doubled or with another role.

    Nulls are written as one space; a null turn stays null in its column.  Other columns go.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))), F.lit(20))
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(code == 4, "user").otherwise(said("role"))
    copies = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies")).withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copies")


def placed(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, place``: places follow conversations and turns, nulls first.

    Rows of one turn follow by the beginnings of role and text and then by a hash; equal
    rows lie side by side.  Sorted by range, so one long conversation covers many tasks.
    """
    read = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    order = ["conv_id", "turn", F.substring("role", 1, 16), F.substring("text", 1, 48), F.xxhash64("role", "text"), F.monotonically_increasing_id()]
    named = read.select("*", *[(c if isinstance(c, Column) else F.col(c)).alias(f"_{i}") for i, c in enumerate(order)])
    by = [f"_{i}" for i in range(len(order))]
    done = named.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("place"))
    return store(done, "placed")


def marks(rows: DataFrame) -> DataFrame:
    """``conv_id, place, mark`` of placed rows: initial and first fault of each (blank, duplicate of an earlier row, truncated)."""
    same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    first = rows.groupBy("conv_id", same.alias("same")).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    bare = F.rtrim(F.col("text"), F.lit(_BLANKS))
    own = F.when(bare == "", 2).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    initial = F.substring("role", 1, 1)
    sign = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    seen = rows.select("conv_id", "place", sign.alias("sign"), own.alias("own")).join(first, "place", "left")
    fault = F.when(F.col("own") == 2, 2).when(F.col("first").isNull(), 3).otherwise(F.col("own"))
    return seen.select("conv_id", "place", F.char(F.lit(65) + 4 * F.col("sign") + fault).alias("mark"))


def _chunks(rows: DataFrame, bits: int) -> DataFrame:
    """``conv_id, id, marks``: neighbouring rows of a conversation; ``id`` is the first one's place, and the others follow it."""
    held = F.array_sort(F.collect_list(F.struct("place", "mark")))
    grouped = rows.groupBy("conv_id", F.shiftright("place", bits).alias("chunk")).agg(F.min("place").alias("id"), F.array_join(F.transform(held, lambda x: x.mark), "").alias("marks"))
    return store(grouped.select("conv_id", "id", "marks"), "chunks")


def _settle(chunks: DataFrame, given: list[int], last: list[int], run: Callable[[str, list[int] | None, list[int]], list[int]]) -> DataFrame:
    """``id, given, result``: each chunk run from its neighbour's result.

    ``chunks`` has ``id, marks, link`` (the neighbour, or null) and ``fixed``.  All begin with
    ``given``, those without a neighbour with ``last``; then those run again whose neighbour
    has come to something else, until there is none.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            out = [run(m, f, g) for m, f, g in zip(d["marks"], d["fixed"], d["given"], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("link"), b.column("given"), pa.array(out, pa.list_(pa.int32()))], names=["id", "link", "given", "result"])

    schema = "id long, link long, given array<int>, result array<int>"
    array = lambda xs: F.array(*[F.lit(x) for x in xs])
    first = F.when(F.col("link").isNull(), array(last)).otherwise(array(given))
    state = store(chunks.withColumn("given", first).mapInArrow(apply, schema), "pass")
    while True:
        told = state.join(state.select(F.col("id").alias("link"), F.col("result").alias("told")), "link", "left")
        stale = (F.col("told").isNotNull()) & (F.col("told") != F.col("given"))
        told = store(told.select("id", "link", F.when(stale, F.col("told")).otherwise(F.col("given")).alias("given"), "result", stale.alias("stale")), "told")
        if told.where("stale").isEmpty():
            return state
        again = told.where("stale").select("id", "link", "given").join(chunks.select("id", "marks", "fixed"), "id").mapInArrow(apply, schema)
        state = store(told.where("NOT stale").select("id", "link", "given", "result").unionByName(again), "pass")


def edits(rows: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """``place, step, edit, role, fault`` of placed rows: D, K and R stand at their row, I before it or, after the last one, behind it.

    ``role`` is that of a changed or inserted row, ``fault`` that of the row itself.
    """
    chunks = _chunks(marks(rows), bits)
    by = Window.partitionBy("conv_id").orderBy("id")
    every = Window.partitionBy("conv_id")
    dead = "".join(m for m, (_, f) in _MARKS.items() if f in ("blank", "duplicate"))
    keys = chunks.select("conv_id", "id", F.col("marks").rlike(f"[^{dead}]").alias("live"), (F.col("id") + F.length("marks") - 1).alias("end"))
    keys = keys.select("conv_id", "id", "live", F.max("end").over(every).alias("end"))
    live = store(keys.where("live").select("id", "end", F.lead("id").over(by).alias("following"), F.lag("id").over(by).alias("before")), "live")
    long = live.where("following IS NOT NULL OR before IS NOT NULL")
    texts = chunks.select("id", "marks")
    none = F.lit(None).cast("array<int>")
    back = _settle(store(long.join(texts, "id").select("id", "marks", F.col("following").alias("link"), none.alias("fixed")), "long"), list(_END), list(_END), lambda m, _, g: list(backward(m, tuple(g))[0]))
    after = back.select("id", F.col("given").alias("after"))
    there = _settle(store(long.join(texts, "id").join(after, "id").select("id", "marks", F.col("before").alias("link"), F.col("after").alias("fixed")), "long"), [3], [0], lambda m, f, g: [forward(backward(m, tuple(f or _END))[1], g[0])[0]])
    whole = texts.join(live, "id", "left").join(after, "id", "left").join(there.select("id", F.col("given")[0].alias("state")), "id", "left")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                c = {n: b.column(n)[i].as_py() for n in b.schema.names}
                state, found = forward(backward(c["marks"], tuple(c["after"] or _END))[1], c["state"] or 0)
                out: dict[str, list] = {"place": [], "step": [], "edit": [], "role": [], "fault": []}
                last, at = -1, 0
                for row, letter, to in found:
                    at = at + 1 if row == last else 0
                    last = row
                    changed = _ROLES[to] if letter in "IR" else None
                    fault = _MARKS[c["marks"][row]][1] or None if letter != "I" else None
                    for k, v in zip(out, (c["id"] + row, at, letter, changed, fault), strict=True):
                        out[k].append(v)
                if c["end"] is not None and c["following"] is None:
                    at = 8
                    while state in (1, 2):
                        state = _NEXT[state]
                        for k, v in zip(out, (c["end"], at, "I", _ROLES[state], None), strict=True):
                            out[k].append(v)
                        at += 1
                yield pa.RecordBatch.from_pydict(out, pa.schema([("place", pa.int64()), ("step", pa.int32()), ("edit", pa.string()), ("role", pa.string()), ("fault", pa.string())]))

    return whole.mapInArrow(trace, "place long, step int, edit string, role string, fault string")


def repair(rows: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """The edited rows: ``conv_id, place, step, turn, role, text, fault, edit, new_role``, in the order of ``place`` and ``step``.

    ``role`` is the one that a row had (null if it is inserted), ``new_role`` the one that it has
    after the repair (null if it is deleted).  A null role or text is one space, a null
    conversation is one of its own.  An empty table stays empty; other columns go.
    """
    ordered = placed(rows)
    log = edits(ordered, bits).withColumnRenamed("role", "changed").join(ordered, "place")
    new = F.col("edit") == "I"
    return log.select(
        "conv_id", "place", "step", F.when(~new, F.col("turn")).alias("turn"), F.when(~new, F.col("role")).alias("role"), F.when(new, "").otherwise(F.col("text")).alias("text"),
        "fault", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(F.col("changed")).alias("new_role"),
    )


def audit(log: DataFrame) -> DataFrame:
    """One row for each conversation of a repair: counts of faults, ``illegal`` neighbours, ``cost``, ``audit`` and the hash of the repaired text.

    A conversation's rows pass one by one through one task, as its hash needs them in a row;
    nothing is held of them but the letters of the audit.
    """
    kind = log.schema["conv_id"].dataType.simpleString()
    prices = {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        none = object()
        now, tally, letters, before, digest, started = none, {}, [], None, None, False
        for b in batches:
            done = []
            kinds = b.schema.field("conv_id").type
            for conv, edit, role, new_role, text, fault in zip(*[b.column(c).to_pylist() for c in ("conv_id", "edit", "role", "new_role", "text", "fault")], strict=True):
                if now is none or conv != now:
                    if now is not none:
                        done.append((now, *tally.values(), "".join(letters), digest.hexdigest()))
                    now, tally, letters, before, digest, started = conv, dict.fromkeys(names[1:6], 0), [], None, hashlib.sha256(), False
                letters.append(edit)
                tally["cost"] += prices[edit]
                if fault:
                    tally[fault] += 1
                    if fault == "truncated" and edit != "D":
                        tally["cost"] += TRUNCATED
                if edit != "I":
                    if before is not None and before + role[:1] not in ("su", "ua", "au"):
                        tally["illegal"] += 1
                    before = role[:1]
                if edit != "D":
                    digest.update(f"{chr(10) * started}{new_role}:{text}".encode())
                    started = True
            if done:
                yield _record(done, names, kinds)
        if now is not none:
            yield _record([(now, *tally.values(), "".join(letters), digest.hexdigest())], names, kinds)

    ordered = log.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step")
    return ordered.mapInArrow(run, f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def _record(rows: list[tuple], names: list[str], first: pa.DataType) -> pa.RecordBatch:
    kinds = [first, *[pa.int64()] * 5, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)


def gaps(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps``: turns that are missing between a conversation's first and last; 0 if all are null."""
    return rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
