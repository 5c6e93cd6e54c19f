"""One-permutation MinHash fingerprints of documents, in DataFrame functions only.

Each five-word shingle is hashed once.  The hash's high bits name a bin, and each bin keeps
its smallest hash.  An empty bin borrows from a bin that its own sequence of hashed
attempts leads to (optimal densification), so two texts borrow alike.  Of each bin the
lowest bits are stored, packed; likeness counts equal ones and takes off those that are
equal by chance.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import checked_broadcast, store

#: Words of a shingle; bins (a power of two); stored bits of each bin, so that a bin is one hexadecimal digit.
WIDTH, BIN_BITS, BITS = 5, 8, 4
BINS = 1 << BIN_BITS
#: Attempts of an empty bin before the filled bins are compared one by one, which few filled bins allow.
ATTEMPTS = 12
#: Documents of one group of neighbours, quantiles of ids and groups inside a quantile at most.
GROUP, QUANTILES, MOST_GROUPS = 1000, 256, 4096
_BLANKS = " \t\n\x0b\f\r"
_DIGITS = "0123456789abcdef"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(text: Column, width: int = WIDTH) -> Column:
    """The hash of each run of ``width`` words ``[^\\x20\\x09-\\x0D]+``; of all words, if there are fewer."""
    bare = F.trim(text, F.lit(_BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    runs = lambda h: F.slice(F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, width)])), F.lit(1), F.greatest(F.size(h) - (width - 1), F.least(F.size(h), F.lit(1))))
    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def _bin(hash_: Column) -> Column:
    return F.shiftright(hash_, 64 - BIN_BITS) + F.lit(BINS // 2).cast("long")


def _low(hash_: Column) -> Column:
    return hash_.bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).cast("int")


def fingerprint(text: Column) -> Column:
    """The packed fingerprint as hexadecimal digits, one for each bin; empty for a text without words, null for null.

    Equal texts have equal fingerprints, as have texts with the same set of shingles.
    """
    smallest = lambda s: F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))

    def spread(filled: Column) -> Column:
        """The low bits by bin, null where a bin is empty."""
        here = lambda x, i: F.concat(F.array(_low(x)), F.array_repeat(F.lit(None).cast("int"), (F.coalesce(_bin(F.get(filled, i + 1)), F.lit(BINS).cast("long")) - _bin(x) - 1).cast("int")))
        return F.concat(F.array_repeat(F.lit(None).cast("int"), _bin(F.get(filled, F.lit(0))).cast("int")), F.flatten(F.transform(filled, here)))

    def dense(filled: Column) -> Column:
        def borrowed(by_bin: Column) -> Column:
            tried = lambda i: [F.get(by_bin, F.pmod(F.xxhash64(i, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(ATTEMPTS)]
            rest = lambda i: _low(F.array_min(F.transform(filled, lambda x: F.xxhash64(i, _bin(x)).bitwiseAND(F.lit(-1 << BITS).cast("long")).bitwiseOR(_low(x).cast("long")))))
            digit = lambda v: F.substring(F.lit(_DIGITS), v + 1, F.lit(1))
            return F.array_join(F.transform(by_bin, lambda v, i: digit(F.coalesce(v, *tried(i), rest(i)))), "")

        return F.when(F.size(filled) == 0, F.lit("")).otherwise(let(spread(filled), borrowed))

    return F.when(text.isNotNull(), let(let(F.sort_array(shingles(text)), smallest), dense))


def likeness(one: Column, two: Column) -> Column:
    """The estimated share of common shingles, 0 to 1: equal digits, less those that chance makes equal.

    Equal fingerprints give 1, those of a text without words and another 0; null gives null.
    """
    same = F.size(F.filter(F.zip_with(F.split(one, ""), F.split(two, ""), lambda a, b: a == b), lambda x: x))
    chance = 1 / (1 << BITS)
    known = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1 - chance)))
    return F.when(one == two, F.lit(1.0)).when((one == "") | (two == ""), F.lit(0.0)).otherwise(known)


def _place(value: Column, bounds: Sequence[int], low: int = 0) -> Column:
    """How many of the sorted ``bounds`` are at or below ``value``: comparisons as a balanced tree."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(value < F.lit(bounds[mid]), _place(value, bounds[:mid], low)).otherwise(_place(value, bounds[mid + 1 :], low + mid + 1))


def _group(docs: DataFrame, key: str) -> Column:
    """A number that follows the order of ``key`` and holds some ``GROUP`` neighbours: quantiles, and even steps inside each; -1 for null."""
    rows, value = docs.count(), F.col(key)
    parts = max(1, min(QUANTILES, rows // GROUP))
    known = [int(x) for x in docs.approxQuantile(key, [i / parts for i in range(parts + 1)], 0.2 / parts)] if rows else []
    low, high = (known[0], known[-1]) if known else (0, 0)
    bounds = sorted({b for b in known[1:-1] if low < b <= high})
    edges, steps = [low, *bounds, high + 1], max(1, min(MOST_GROUPS, rows // (parts * GROUP)))
    place = _place(value, bounds)
    if steps == 1:
        return F.coalesce(place.cast("long"), F.lit(-1).cast("long"))
    widths = [max(1, -(-(b - a) // steps)) for a, b in zip(edges, edges[1:], strict=False)]
    array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    step = F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.floor((value - F.get(array(edges[:-1]), place)) / F.get(array(widths), place))))
    return F.coalesce(place.cast("long") * steps + step, F.lit(-1).cast("long"))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``text`` and ``fingerprint`` of each row, with ``next_text`` and ``next_fingerprint``: the row that follows by descending ``key``, after the last the first.

    Rows with a null key come last, equal keys in the order of their texts, and each
    repeated row counts.  A null text is empty.  Neighbours share a group, which one shuffle
    brings together; the first row of each group also stands behind the group before it.
    A table of one row is followed by itself, an empty one stays empty.
    """
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    rows = rows.select(_group(rows, "_key").alias("_group"), "*")
    tops = store(rows.groupBy("_group").agg(F.max("_key").alias("_top")), "tops")
    before = F.coalesce(F.lead("_group").over(Window.orderBy("_group")), F.min("_group").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    tops = store(tops.select("_group", "_top", before.alias("_behind")), "tops")
    heads = rows.alias("a").join(checked_broadcast(tops).alias("b"), (F.col("a._group") == F.col("b._group")) & F.col("a._key").eqNullSafe(F.col("b._top")))
    heads = heads.groupBy(F.col("_behind").alias("_group")).agg(F.min("_text").alias("_text"))
    all_rows = rows.withColumn("_last", F.lit(False)).unionByName(heads.select("_group", F.lit(None).cast("long").alias("_key"), "_text", F.lit(True).alias("_last")))
    all_rows = all_rows.withColumn("_print", fingerprint(F.col("_text")))
    order = Window.partitionBy("_group").orderBy("_last", F.desc_nulls_last("_key"), "_text")
    following = all_rows.select("*", F.lead("_text").over(order).alias("next_text"), F.lead("_print").over(order).alias("next_fingerprint")).where("NOT _last")
    return following.select(F.col("_key").alias(key), F.col("_text").alias(text), F.col("_print").alias("fingerprint"), "next_text", "next_fingerprint")


def edited(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    ``docs`` has ``doc_id`` and ``text``; other columns are left out.  The edited text has its
    last half replaced by as much of the beginning of the next one.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs).withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))})
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.withColumns({"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("next_fingerprint"))})
