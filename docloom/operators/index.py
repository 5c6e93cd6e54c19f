"""The keyed index of daily entries: a new day goes to the front, a known day is replaced in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.io import stored


def upsert(log: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """The index that a log leaves: per key its latest value and when it was first seen.

    Both are partial aggregates, so the log shuffles once and already summed up.  Replaying
    part of the log changes nothing.
    """
    return log.groupBy(key).agg(F.max_by(value, seq).alias(value), F.min(seq).alias("first_seen"), F.max(seq).alias("last_seen"))


def merge(snapshot: DataFrame, delta: DataFrame, key: str, value: str) -> DataFrame:
    """A snapshot and the index of another part of the log as one: the value last seen wins, the first sighting stays."""
    s = snapshot.select(key, F.col(value).alias("s_value"), F.col("first_seen").alias("s_first"), F.col("last_seen").alias("s_last"))
    d = delta.select(key, F.col(value).alias("d_value"), F.col("first_seen").alias("d_first"), F.col("last_seen").alias("d_last"))
    return s.join(d, key, "full").select(key, F.when(F.col("d_last").isNull() | (F.col("s_last") > F.col("d_last")), F.col("s_value")).otherwise(F.col("d_value")).alias(value), F.least("s_first", "d_first").alias("first_seen"), F.greatest("s_last", "d_last").alias("last_seen"))


def positions(index: DataFrame, key: str = "d") -> DataFrame:
    """The order of the index, as ``position`` from 1: the newest first sighting comes first, ties by ``key``, nulls last."""
    return numbered(index, [F.desc_nulls_last("first_seen"), F.asc_nulls_last(key)])


def numbered(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``rows`` numbered from 1 in an order over all of them, without sorting them in one task.

    They are sorted by range; each partition numbers its own rows and adds the rows of those
    before it.  The counts, one for each partition, are all that the driver sees.  Rows
    that are equal in the order are numbered as they lie, so the order should tell rows apart.
    """
    placed = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = sorted(tuple(r) for r in placed.groupBy("_part").count().collect())
    before, sums = 0, []
    for part, n in counts:
        sums.append((part, before))
        before += n
    known = placed.sparkSession.createDataFrame(sums, "_part int, _before long")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(F.broadcast(known), "_part").withColumn(name, F.col("_before") + own).drop("_part", "_before")
