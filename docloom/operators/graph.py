"""Groups of rows that links join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources.io import stored


def groups(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``group`` (the smallest node reachable) for each node of ``links`` (a, b) that has another.

    Every node takes the smallest label around it and then the label of its label, until none
    changes.  Links may repeat and point either way; loops and nulls are ignored, no link gives
    no row.  Each round is stored, so a lost executor costs one round at most.
    """
    a, b = links.columns[:2]
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "links")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = stored(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("group")), "labels")
    for _ in range(max_rounds):
        around = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("group").alias("seen"))
        near = labels.join(around, "node").select("node", "group", F.least("group", "seen").alias("new"))
        above = labels.select(F.col("node").alias("new"), F.col("group").alias("above"))
        now = stored(near.join(above, "new", "left").select("node", "group", F.least("new", "above").alias("new")), "labels")
        labels = now.select("node", F.col("new").alias("group"))
        if now.where("new <> group").isEmpty():
            return labels
    raise RuntimeError(f"labels have not settled within {max_rounds} rounds")
