"""Lookups against small tables, ranges, replacement and retry sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows, and characters of all their values, up to which a lookup table is broadcast; a larger one is joined by shuffle.
LOOKUP_ROWS, LOOKUP_CHARS = 100_000, 16 << 20


def small(lookup: DataFrame) -> DataFrame:
    """``lookup`` with a broadcast hint if its counted rows and characters allow it."""
    rows, chars = lookup.agg(F.count("*"), F.sum(F.length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(lookup) if rows <= LOOKUP_ROWS and (chars or 0) <= LOOKUP_CHARS else lookup


def resolve_provider(requests: DataFrame, providers: DataFrame, name: str) -> DataFrame:
    """Requests with their provider's settings; ``unknown`` and ``config_missing`` are states, not errors."""
    known = providers.select(F.lower("name").alias("_name"), "type", "model_id", "has_key")
    rows = requests.join(small(known), F.lower(F.col(name)) == F.col("_name"), "left")
    return rows.withColumn("status", F.when(F.col("_name").isNull(), "unknown").when(~F.col("has_key"), "config_missing").otherwise("ok")).drop("_name", "has_key")


def with_template(docs: DataFrame, templates: DataFrame, name: str, default: str) -> DataFrame:
    """Documents with the body of one named template, or the default if it is missing."""
    body = templates.where(F.col("name") == name).agg(F.first("body").alias("body"))
    return docs.crossJoin(F.broadcast(body)).withColumn("body", F.coalesce("body", F.lit(default)))  # one row: an aggregate without keys


def retry_set(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs without a successful output."""
    return inputs.join(outputs.where("status = 'ok'").select(key).distinct(), key, "left_anti")


def replacement(inputs: DataFrame, temp: DataFrame, paths: DataFrame, name: str) -> DataFrame:
    """The text of the named temp file, else of the path, else the input's own."""
    t = temp.select(F.col("name").alias(name), F.col("text").alias("temp_text"))
    p = paths.select(F.col("name").alias(name), F.col("text").alias("path_text"))
    rows = inputs.join(t, name, "left").join(p, name, "left")
    origin = F.when(F.col("temp_text").isNotNull(), "temp").when(F.col("path_text").isNotNull(), "path").otherwise("original")
    return rows.withColumn("text", F.coalesce("temp_text", "path_text", "text")).withColumn("origin", origin).drop("temp_text", "path_text")


#: Steps that the widest range is cut into at most.
RANGE_STEPS = 1000


def in_range(rows: DataFrame, ranges: DataFrame, value: Column) -> DataFrame:
    """Rows with the range (``lo``, ``hi``, inclusive) that holds ``value``; without one the range is null.

    The line of numbers is cut into steps as wide as a thousandth of the widest range, at least 1;
    a range is listed at each step that it touches, so however wide it is it has about a thousand rows at most, and the
    join is on the step.  A null value or a range without a bound meets nothing; a value in two
    ranges comes twice.
    """
    widest = ranges.agg(F.max(F.col("hi").cast("long") - F.col("lo").cast("long"))).first()[0] or 0
    width = max(1, -(-widest // RANGE_STEPS))
    step = lambda c: F.floor(c.cast("long") / width)
    known = ranges.where("lo <= hi").select("*", F.explode(F.sequence(step(F.col("lo")), step(F.col("hi")))).alias("_step"))
    given = rows.withColumn("_at", value.cast("long"))
    known = small(known.withColumnRenamed("lo", "_lo").withColumnRenamed("hi", "_hi"))
    return given.join(known, (step(F.col("_at")) == F.col("_step")) & F.col("_at").between(F.col("_lo"), F.col("_hi")), "left").drop("_at", "_step", "_lo", "_hi")


def union_by_provider(*runs: tuple[str, DataFrame]) -> DataFrame:
    """The outputs of several providers for the same sources, told apart by ``provider``."""
    first, *rest = [df.withColumn("provider", F.lit(name)) for name, df in runs]
    for df in rest:
        first = first.unionByName(df)
    return first
