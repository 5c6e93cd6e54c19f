"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the documents of the next one.

All stages but the last return the columns of their input, whatever these are called, and
an empty table for an empty one.  Rows with a null or repeated id are judged each by its own
text; null, empty and blank texts pass the first stage and go in the second, which they reach without a word.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm import line_dedup, minhash, packing, quality_rules, toxicity
from docloom.llm.common import store, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on their labels, does not reject; without labels all stay."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep enough of their text under the line rules, without their failing lines; short ones stay."""
    return quality_rules.clean(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of line runs; a document that is nothing else goes, rows with a null id stay as they are."""
    return line_dedup.strip(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8); rows with a null id stay."""
    return minhash.keep_one(docs, width=5, percent=80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences of 2048 tokens; each row is packed, whatever its id."""
    return packing.pack(docs, packing.with_end(public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", clean_lines),
    ("line_dedup", drop_repeated_lines),
    ("minhash", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: SQL can express neither the trained classifier nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the ``documents`` table; each result is stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
