"""Ordered assembly of response chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble(chunks: DataFrame, key: Sequence[str], *, policy: str = "partial", failure: str = "request failed: ") -> DataFrame:
    """One row per request: its text, whether it failed, and the number of chunks used.

    Chunks (``seq``, ``text``, ``error``) are joined in order up to the first error.
    After an error the policy ``partial`` keeps what came before, or the failure text
    if nothing did; ``drop`` gives a null text.
    """
    parts = F.sort_array(F.collect_list(F.struct("seq", "text", "error")))
    rows = chunks.groupBy(*key).agg(parts.alias("parts"), F.min(F.when(F.col("error").isNotNull(), F.col("seq"))).alias("stop"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("error"))
    good = F.filter("parts", lambda p: (F.col("stop").isNull() | (p["seq"] < F.col("stop"))) & (F.coalesce(p["text"], F.lit("")) != ""))
    text = F.array_join(F.transform(good, lambda p: p["text"]), "")
    failed = F.col("stop").isNotNull()
    if policy == "drop":
        text = F.when(~failed, text)
    else:
        text = F.when(failed & (text == ""), F.concat(F.lit(failure), F.col("error"))).otherwise(text)
    return rows.select(*key, text.alias("text"), failed.alias("failed"), F.size(good).cast("long").alias("n_chunks"))
