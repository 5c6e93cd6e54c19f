"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Centres are fitted on a bounded sample, in two independent sets; every vector goes to the
NEAREST cells of each set.  Two vectors at the wanted cosine share one of these eight cells
but for about one pair in a million (measured on directions without any structure, the
worst case, for up to 1,500 cells).  Cells grow with the square root of the largest label,
so a vector meets about as many centres as members.  Inside a cell, blocks of vectors are
multiplied; a pair that shares several cells counts in the first.  A block pair returns link
counts and a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import store
from docloom.llm.components import components

#: Rows of the sample on which centres are fitted, the most centres of a set, and the vectors of one block.
SAMPLE, MOST_CELLS, BLOCK = 20_000, 4096, 4096
#: Sets of centres, and the cells of each set that a vector goes to.
SETS, NEAREST = 2, 4
#: Rows of a block that are multiplied at a time.
STRIP = 512
#: Pairs that are looked at together, and doubles of their vectors.
PAIRS, PRODUCTS = 1 << 18, 1 << 21


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """Unit centres of unit rows ``x``; an empty cell keeps its centre."""
    if not len(x):
        return np.zeros((0, x.shape[1]))
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        cell = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        norm = np.linalg.norm(sums, axis=1)
        centres[norm > 1e-12] = sums[norm > 1e-12] / norm[norm > 1e-12, None]
    return centres


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, whatever their magnitude."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def nearest_cells(x: np.ndarray, sets: list[np.ndarray], nearest: int = NEAREST) -> np.ndarray:
    """The numbers of the cells of each unit row, ascending; sets are numbered one after the other."""
    found, base = [], 0
    for centres in sets:
        k = min(nearest, len(centres))
        found.append(np.argpartition(-(x @ centres.T), k - 1, axis=1)[:, :k] + base)
        base += len(centres)
    return np.sort(np.hstack(found), axis=1).astype(np.int32)


def _valid(vectors: DataFrame, label: str) -> DataFrame:
    """Rows that can link: an id, a label, and a finite vector that is not zero, as doubles."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(finite & F.exists("v", lambda x: x != 0))


def fit_cells(groups: DataFrame, cells: int | None) -> dict[int, list[np.ndarray]]:
    """Sets of centres for each vector length, from a sample of at most about SAMPLE rows.

    Without ``cells`` their number is the square root of the rows of the largest label.
    """
    total = groups.count()
    largest = groups.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    k = cells or min(MOST_CELLS, max(2, round(largest**0.5)))
    share = min(1.0, SAMPLE / max(1, total))
    sample = groups.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(share * 1_000_000)).select("v")
    sized: dict[int, list] = {}
    for row in sample.orderBy(F.xxhash64("v"), "v").collect():
        sized.setdefault(len(row.v), []).append(row.v)
    return {width: [spherical_kmeans(units(np.array(rows, float))[s::SETS], k, seed=11 + s) for s in range(SETS)] for width, rows in sized.items() if len(rows) >= 4 * SETS}


def near_duplicates(vectors: DataFrame, *, label: str = "label", cosine: float = 0.98, cells: int | None = None) -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Only vectors of equal, non-null label and equal length are compared.  Vectors that
    are null, zero or hold null or non-finite components link with nothing; they and rows
    with a null id count as kept.  Equal vectors of a label are one node that counts its
    copies.  Rows that share an id are judged each by its own vector.  An empty table gives
    no row, and other columns of the input are not looked at.
    """
    # equal vectors collapse to one row: their links among each other are known
    groups = store(_valid(vectors, label).groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    centres = fit_cells(groups, cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                col = part.column("v")
                width = np.diff(col.offsets.to_numpy())
                cells_of: list = [None] * part.num_rows
                for w in np.unique(width):
                    rows = np.flatnonzero(width == w)
                    if int(w) in centres:
                        x = np.asarray(col.take(pa.array(rows)).flatten(), float).reshape(len(rows), w)
                        for r, c in zip(rows, nearest_cells(units(x), centres[int(w)]), strict=True):
                            cells_of[r] = c
                    else:  # so few vectors of this length that they are one cell
                        for r in rows:
                            cells_of[r] = [-1]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells_of, pa.list_(pa.int32()))], names=[*part.schema.names, "cells"])

    placed = store(groups.mapInArrow(place, "label string, v array<double>, rep long, copies long, cells array<int>").withColumn("width", F.size("v")), "placed")
    key = ["label", "width", "cell"]
    # the representative is unique among the vectors of a label only with the vector itself, so the row has a number of its own
    visit = placed.select("label", "width", F.explode("cells").alias("cell"), "cells", F.xxhash64("v", "rep").alias("gid"), "v", "rep", "copies")
    counted = store(placed.select("label", "width", F.explode("cells").alias("cell")).groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "cells")
    visit = visit.join(counted, key).withColumn("own", F.pmod("gid", F.col("blocks")).cast("int"))
    # every two blocks of a cell meet once: a vector goes to the pairs of its block with each other
    visit = visit.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = visit.select(*key, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "gid", "rep", "copies", "cells", "v")
    found = store(work.groupBy(*key, "low", "high").applyInArrow(_compare(cosine), "label string, gid long, rep long, links long, other long"), "links")

    edges = found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    comp = store(components(edges), "components")
    links = found.where("other IS NULL").groupBy("label", "gid", "rep").agg(F.sum("links").alias("links"))
    known = groups.withColumn("gid", F.xxhash64("v", "rep")).join(links, ["label", "gid", "rep"], "left").join(comp, F.col("rep") == F.col("node"), "left")
    known = store(known.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "known")

    # rows that cannot link find no equal vector here; a null id belongs to none
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id").isNotNull(), F.col(label).cast("string")).alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    out = every.join(known, ["label", "v"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _first_shared(cells: np.ndarray, i: np.ndarray, j: np.ndarray, cell: int) -> np.ndarray:
    """Whether the rows of each pair (i, j) share no cell with a smaller number than ``cell``."""
    earlier = np.zeros(len(i), bool)
    for a in range(cells.shape[1]):
        mine = cells[i, a]
        for b in range(cells.shape[1]):
            earlier |= (mine == cells[j, b]) & (mine < cell)
    return ~earlier


def _join(group: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Bring the rows of each pair into one group, named after its first row."""
    while len(i):
        a, b = group[i], group[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(group, np.maximum(a, b), np.minimum(a, b))
        while (group[group] != group).any():
            group[:] = group[group]


def _compare(cosine: float) -> Callable[[pa.Table], pa.Table]:
    def apply(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        own, gid, reps, copies = (t.column(c).to_numpy() for c in ("own", "gid", "rep", "copies"))
        label, cell, low, high = (t.column(c)[0].as_py() for c in ("label", "cell", "low", "high"))
        matrix = lambda c, kind: np.asarray(t.column(c).combine_chunks().flatten(), kind).reshape(len(own), -1)
        cells, x = matrix("cells", np.int32), matrix("v", float)
        x = x / np.abs(x).max(axis=1)[:, None]
        norm = np.sqrt((x * x).sum(axis=1))
        single = (x / norm[:, None]).astype(np.float32)
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        count = np.zeros(len(own), np.int64)
        group = np.arange(len(own))
        # a sum of so many single-precision products may be off by that much
        pairs, margin = max(1, PRODUCTS // x.shape[1]), max(1e-5, x.shape[1] * 2.0**-23)

        for at in range(0, len(left), STRIP):
            rows = left[at : at + STRIP]
            product = single[rows] @ single[right].T
            hits = np.flatnonzero(product >= cosine - margin)  # a place of the strip each, in one number
            for begin in range(0, len(hits), PAIRS):
                i, j = np.divmod(hits[begin : begin + PAIRS], len(right))
                sure = product[i, j] >= cosine + margin
                i, j = rows[i], right[j]
                # what the product leaves open is held against the definition, in doubles
                for a in range(0, len(open_ := np.flatnonzero(~sure)), pairs):
                    part = open_[a : a + pairs]
                    sure[part] = (x[i[part]] * x[j[part]]).sum(axis=1) / (norm[i[part]] * norm[j[part]]) >= cosine
                if low == high:
                    sure &= i < j
                i, j = i[sure], j[sure]
                first = _first_shared(cells, i, j, cell)
                i, j = i[first], j[first]
                np.add.at(count, i, copies[j])
                np.add.at(count, j, copies[i])
                _join(group, i, j)
        counted = [(label, int(gid[k]), int(reps[k]), int(count[k]), None) for k in np.flatnonzero(count)]
        smallest = np.full(len(own), np.iinfo(np.int64).max)
        np.minimum.at(smallest, group, reps)
        forest = sorted({(label, 0, int(a), 0, int(b)) for a, b in zip(reps, smallest[group], strict=True) if a != b})
        columns = list(zip(*(counted + forest), strict=True)) or [()] * 5
        return pa.table({"label": pa.array(columns[0], pa.string())} | {n: pa.array(c, pa.int64()) for n, c in zip(("gid", "rep", "links", "other"), columns[1:], strict=True)})

    return apply
