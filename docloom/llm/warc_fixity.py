"""Merkle fixity audit of archived records.

Records of a file, ordered by their place, are hashed; fixed ranges of places, which are
offset ranges of the file, form the nodes of the next level up to one node per file, and
ranges of files the levels above, up to a single root.  Every node is the SHA-256 of its
children in order: number, offset within the node, bytes and digest of each.  Two
replicas are compared from the roots down, and only the children of nodes that differ are
read.  All of it is joins and grouped aggregates over built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import store

#: Children of a node.  A level has this many times fewer nodes than the one below.
FANOUT = 16


def warc_record(url: Column, payload: Column) -> Column:
    """The bytes of a WARC response record for a payload; null parts are empty."""
    body = F.coalesce(payload.cast("binary"), F.lit(b""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit(b"\r\n\r\n"))


def leaves(records: DataFrame) -> DataFrame:
    """``file``, ``place``, ``length``, ``digest``, ``offset`` of rows (file, place, record).

    Records that share a place are summed up without order: their count, smallest and
    largest hash and a sum.  The offset is where a place begins in its file.
    """
    rows = records.select("file", "place", F.length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    several = F.concat_ws(":", F.count("*").cast("string"), F.min("digest"), F.max("digest"), F.sum(F.xxhash64("digest").cast("decimal(38,0)")).cast("string"))
    low = rows.groupBy("file", "place").agg(F.sum("length").alias("length"), F.when(F.count("*") == 1, F.min("digest")).otherwise(several).alias("digest"))
    before = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return low.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def _up(number: Column, fanout: int) -> Column:
    """The number of the node above, in whole numbers; -1 stands above itself."""
    return F.call_function("div", number - F.pmod(number, F.lit(fanout)), F.lit(fanout))


def _parents(nodes: DataFrame) -> DataFrame:
    """The level above ``nodes``, which name their parent in (up_file, up_node)."""
    child = F.struct(F.col("file").alias("f"), F.col("node").alias("n"), "first", "bytes", "digest")
    line = lambda c: F.concat_ws(":", c["f"], c["n"], c["first"] - F.col("first"), c["bytes"], c["digest"])
    level = nodes.groupBy(F.col("up_file").alias("file"), F.col("up_node").alias("node")).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("bytes").alias("bytes"), F.sort_array(F.collect_list(child)).alias("children"))
    return level.select("file", "node", "first", "last", "bytes", F.sha2(F.array_join(F.transform("children", line), "\n"), 256).alias("digest"))


def levels_over(size: int, fanout: int) -> int:
    """Levels until ``size`` numbers from 0 on are one."""
    levels = 0
    while fanout**levels < size:
        levels += 1
    return levels


def tree(records: DataFrame, file_places: int, files: int, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of a replica's tree from leaves to the one root; each is stored once.

    Nodes hold no more than ``fanout`` children, but for those of a file (one for its
    places, one for records without a place) and the root (one for files, one for records without one).
    """
    low = leaves(records).select("file", F.col("place").alias("node"), F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("last"), F.col("length").alias("bytes"), "digest")
    zero, here, above = F.lit(0).cast("long"), F.col("file"), _up(F.col("file"), fanout)
    places, ranges = levels_over(file_places, fanout), levels_over(files, fanout)
    ups = [(here, _up(F.col("node"), fanout))] * places + [(here, zero)] + [(above, zero)] * ranges + [(zero, zero)]
    out = [store(low.withColumns({"up_file": ups[0][0], "up_node": ups[0][1]}), "leaves")]
    for up in [*ups[1:], (zero, zero)]:
        out.append(store(_parents(out[-1]).withColumns({"up_file": up[0], "up_node": up[1]}), "nodes"))
    return out


def root(level: DataFrame) -> str | None:
    """The digest of the root; None for an archive without records."""
    found = level.select("digest").first()
    return found.digest if found else None


def audit(one: DataFrame, two: DataFrame, *, file_places: int, fanout: int = FANOUT) -> DataFrame:
    """Places whose records differ between two replicas: ``file``, ``place``, ``status``, and offset, length and digest in either.

    Both have ``file`` (long), ``place`` (long, below ``file_places`` in its file) and
    ``record`` (binary); other columns are not looked at.  ``status`` is ``changed``, ``missing``
    (not in the second) or ``extra`` (only in the second).  A null record counts as empty; rows
    with a null file or place are one file or place of their own, which comes back as
    null.  Records that share a place are one entry, without order.  Equal replicas, two empty
    ones among them, give no row, and an audit of equal roots reads no level below them.
    """
    none = F.lit(-1).cast("long")
    clean = lambda df: df.select(F.coalesce(F.col("file").cast("long"), none).alias("file"), F.coalesce(F.col("place").cast("long"), none).alias("place"), F.coalesce("record", F.lit(b"")).alias("record"))
    one, two = clean(one), clean(two)
    # both trees have the same levels, enough for the largest file number of either
    files = 1 + (one.select("file").unionAll(two.select("file")).agg(F.max("file")).first()[0] or 0)
    first, second = tree(one, file_places, files, fanout), tree(two, file_places, files, fanout)
    same = root(first[-1]) == root(second[-1])
    differing: DataFrame | None = None
    for depth in range(len(first) - 1, -1, -1):
        a, b = first[depth], second[depth]
        if same:
            a, b = a.where(F.lit(False)), b.where(F.lit(False))
        if differing is not None:
            a, b = (x.join(differing, ["up_file", "up_node"], "left_semi") for x in (a, b))
        pick = lambda x, s: x.select("file", "node", F.col("digest").alias(f"digest_{s}"), F.col("bytes").alias(f"length_{s}"), F.col("first").alias(f"offset_{s}"))
        both = pick(a, "one").join(pick(b, "two"), ["file", "node"], "full").where(~F.col("digest_one").eqNullSafe(F.col("digest_two")))
        if depth:
            differing = store(both.select(F.col("file").alias("up_file"), F.col("node").alias("up_node")), "differing")
    status = F.when(F.col("digest_two").isNull(), "missing").when(F.col("digest_one").isNull(), "extra").otherwise("changed")
    given = lambda c: F.nullif(F.col(c), none)
    return both.select(given("file").alias("file"), given("node").alias("place"), status.alias("status"), "offset_one", "length_one", "offset_two", "length_two", "digest_one", "digest_two")
