"""Merging of equal items, and classes of near-duplicate items."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.graph import groups
from docloom.operators.lookups import small
from docloom.sources.io import stored


def merge_equal(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", links: str = "source") -> DataFrame:
    """Documents of equal text as one: smallest id, number merged, sorted union of ``links``."""
    key = F.sha2(text, 256)
    return docs.groupBy(key.alias("item_key")).agg(F.min(id_).alias("first_id"), F.count("*").alias("merged"), F.array_join(F.sort_array(F.collect_set(links)), "|").alias("links"))


#: Characters of text whose shingles meet in one task, on average.
PART_CHARS = 24_000_000


def shingles(docs: DataFrame, text: str, width: int) -> DataFrame:
    """The other columns and ``s``, the distinct hashes of the text's word n-grams; fewer words than ``width`` are one, none give an empty list."""
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+"), "")
    rest = [c for c in docs.columns if c != text]
    # generators of one row keep the optimizer from splitting and hashing anew for each use; a hash of hashes spares the texts of n-grams
    rows = docs.select(*rest, F.inline(F.array(F.struct(F.transform(words, lambda w: F.xxhash64(w)).alias("_h")))))
    last = F.greatest(F.size("_h") - width, F.least(F.size("_h"), F.lit(1)) - 1)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(starts, lambda i: F.xxhash64(*(F.get("_h", i + j) for j in range(width))))
    return rows.select(*rest, F.inline(F.array(F.struct(F.array_distinct(grams).alias("s")))))


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of ``percent`` in a hundred or more; ``sets``: ``node``, size ``n`` and ``t``, those of its tokens that others have."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("t").alias(f"t_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("shared", F.size(F.array_intersect("t_a", "t_b")))
    return both.where(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def _candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes in different groups that a common token allows to be similar enough.

    ``rows``: token ``x``, ``node``, its size ``n``, ``place`` of the token in its order, group ``g``.  Where the
    first common token of two sets stands at places i and j, they share 1 + min(n - i, m - j)
    tokens at most, and need percent * (n + m) / (100 + percent).  So a place bounds the sizes of
    the sets that it can be similar to: the larger set goes to the sizes below it that its place
    allows, by steps of a tenth, and the smaller one waits at its own if its place allows any
    as large.  A token that many sets have near the end of their order, as they have the
    words of a notice, thus brings none of them together.
    """
    reach = F.floor((1 + F.col("n") - F.col("place")) * (100 + percent) / percent + 1e-9) - F.col("n")
    step = lambda n: F.floor(F.log(n.cast("double")) / math.log(1.1)).cast("int")
    large = rows.select("x", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("g").alias("g_a"), F.ceil(F.col("n") * percent / 100 - 1e-9).alias("low"), F.least("n", reach).alias("high")).where("low <= high")
    large = large.withColumn("step", F.explode(F.sequence(step(F.col("low")), step(F.col("high")))))
    less = rows.select("x", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("g").alias("g_b"), reach.alias("reach")).where("reach >= n_b").withColumn("step", step(F.col("n_b")))
    met = large.join(less, ["x", "step"]).where("g_a <> g_b AND n_b BETWEEN low AND high AND n_a <= reach AND (n_b < n_a OR a < b)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_items(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", width: int = 3, percent: int = 50) -> DataFrame:
    """Classes of similar items, one row per item: ``id``, ``n_shingles``, ``class_id``, ``members``, ``linked``, ``head``.

    Items are sets of word shingles; two are linked when the Jaccard similarity of their
    sets is at least ``percent`` in a hundred, and a class is all that links join.  An
    item of fewer words than ``width`` is one shingle, one without words is alone.
    ``class_id`` is the smallest id of the class, ``members`` its number of rows,
    ``linked`` says whether it has others and ``head`` whether the row bears that id.
    Rows with a null id are alone; rows that share an id are judged each by its text.

    No link is lost: with shingles ordered from rare to frequent, two sets that are
    similar enough share one among the first of each (prefix filter).  Equal texts are
    one node.  Shingles that one node alone has are counted and dropped as soon as they have met: they
    come first in the order and no two sets share them.  In each bucket of the others all nodes are held against its smallest
    node first, so a group of n copies costs about n comparisons; only where members
    then still lie in different groups are they compared with each other, and there only those
    that the token's places allow to be similar (position filter).
    """
    docs = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("_text"))
    node = F.xxhash64(F.sha2("_text", 256)).alias("node")
    worded = F.col("id").isNotNull() & F.lower("_text").rlike(r"\p{L}")
    sets = shingles(docs.where(worded).select(node, "_text").groupBy("node").agg(F.min("_text").alias("_text")), "_text", width)

    # tokens meet in parts of a bounded size, so that a task sorts them in memory however many there are
    parts = max(4 * docs.sparkSession.sparkContext.defaultParallelism, (docs.agg(F.sum(F.length("_text"))).first()[0] or 0) // PART_CHARS + 1)
    # a node's size goes with its tokens, below zero with the first of them, which stays whether shared or not
    tokens = sets.select("node", F.size("s").alias("n"), F.posexplode("s").alias("pos", "x")).select("node", F.when(F.col("pos") == 0, -F.col("n")).otherwise(F.col("n")).alias("n"), "x")
    often = tokens.repartition(parts, "x").withColumn("df", F.count("*").over(Window.partitionBy("x"))).where("df > 1 OR n < 0")
    # the order of tokens: by the powers of two that their number of nodes lies between, then by 58 bits of their hash
    ordered = F.shiftleft(F.floor(F.log2("df")).cast("long"), 58).bitwiseOR(F.col("x").bitwiseAND(F.lit((1 << 58) - 1)))
    held = often.select("node", F.abs("n").alias("n"), F.when(F.col("df") > 1, ordered).alias("x"))
    common = stored(held.groupBy("node").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("x")).alias("t")), "near-common")
    place = (F.col("n") - F.size("t") + F.col("pos") + 1).alias("place")
    kept = F.size("t") - F.ceil(F.col("n") * percent / 100) + 1
    first = common.where(kept > 0).select("node", "n", "t", F.posexplode(F.slice("t", F.lit(1), kept.cast("int"))).alias("pos", "x"))
    members = stored(first.select("x", "node", "n", place), "near-buckets")

    heads = stored(members.groupBy("x").agg(F.min("node").alias("a")), "near-heads")
    tried = members.join(heads, "x").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    links = stored(_similar(tried, common, percent), "near-links")
    found = groups(links)

    placed = stored(members.join(found, "node", "left").select("x", "node", "n", "place", F.coalesce("group", "node").alias("g")), "near-placed")
    open_ = stored(placed.groupBy("x").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("x"), "near-open-tokens")
    todo = stored(placed.join(open_, "x"), "near-open")
    rest = _candidates(todo, percent)
    more = stored(_similar(rest, common, percent), "near-links")
    found = groups(links.unionByName(more))

    # texts are read again, for their hashes, and not moved again
    rows = stored(docs.where("id IS NOT NULL").select("id", F.when(worded, node).alias("node")), "near-rows")
    names = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("first")).join(found, "node", "left").select("node", "first", F.coalesce("group", "node").alias("group"))
    smallest = names.groupBy("group").agg(F.min("first").alias("class_id"))
    classes = names.join(smallest, "group").select("node", "class_id").join(common.select("node", F.col("n").cast("long").alias("n_shingles")), "node")
    rows = rows.join(classes, "node", "left").select("id", F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), F.coalesce("class_id", "id").alias("class_id"))
    without = shingles(docs.where("id IS NULL"), "_text", width).select("id", F.size("s").cast("long").alias("n_shingles"), F.col("id").alias("class_id"))
    rows = stored(rows.unionByName(without), "near-items")
    many = stored(rows.where("class_id IS NOT NULL").groupBy("class_id").agg(F.count("*").alias("members")).where("members > 1"), "near-sizes")
    out = rows.join(small(many), "class_id", "left").withColumn("members", F.coalesce("members", F.lit(1).cast("long")))
    return out.select("id", "n_shingles", "class_id", "members", (F.col("members") > 1).alias("linked"), F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("head"))


def merge_near(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", links: str = "source", width: int = 3, percent: int = 50) -> DataFrame:
    """Similar items as one: ``class_id``, ``merged`` (rows), ``links`` (their sorted distinct union).

    Rows with a null id are left out.  Distinct links are found first, so a class of any
    number of rows brings no more than its distinct links together.
    """
    found = near_items(docs, id_=id_, text=text, width=width, percent=percent)
    of_id = found.where("id IS NOT NULL").groupBy("id").agg(F.min("class_id").alias("class_id"))
    rows = docs.select(F.col(id_).cast("long").alias("id"), F.col(links).alias("link")).join(of_id, "id")
    each = rows.groupBy("class_id", "link").agg(F.count("*").alias("n"))
    return each.groupBy("class_id").agg(F.sum("n").alias("merged"), F.array_join(F.sort_array(F.collect_list("link")), "|").alias("links"))
