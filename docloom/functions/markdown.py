"""Marks inside Markdown text: tags, numbered points and annotations; its lines are the matter of ``blocks``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def hash_tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"#([^\s#*]+)"), F.lit(1))


def points(text: Column) -> Column:
    """The texts of numbered points ``n.m text``."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^\d+\.\d+ +(.*)$"), F.lit(1))


def annotations(text: Column) -> Column:
    """Annotated terms ``**term** (/ipa/, gloss)`` as structs; the ipa is optional."""
    pattern = r"\*\*([^*]+)\*\* \((?:/([^/]*)/, )?([^()]*)\)"
    group = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    return F.arrays_zip(group(1).alias("term"), group(2).alias("ipa"), group(3).alias("gloss"))


def without_annotations(text: Column) -> Column:
    return F.regexp_replace(text, r"\*\*([^*]+)\*\* \((?:/[^/]*/, )?[^()]*\)", "$1")
