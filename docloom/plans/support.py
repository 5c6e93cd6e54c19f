"""Reading tables, and fixtures derived from them by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in four partitions a core, so that a table in few splits still keeps all cores at work on what is made of it."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def sql_fixture(spark: SparkSession, sf_dir: str, sql: str, **names: str) -> DataFrame:
    """``sql`` over tables given as ``{alias}`` placeholders."""
    return spark.sql(sql, **{alias: table(spark, sf_dir, name) for alias, name in names.items()})


def cte(**parts: str) -> str:
    """A WITH clause of fixtures for the SQL twins."""
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in parts.items()) + " "


def once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns, each computed once.

    A generator of one row stands between them and later filters, so the optimizer
    cannot copy an expensive expression into every place that mentions it.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
