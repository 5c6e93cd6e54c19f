"""Markdown as typed blocks: headings, nested list items, numbered points, table cells by header, key and value.

Each document is parsed where it lies (``block_lines``): a block knows the headings, the table
header and the list item that it stands under.  Layouts drift between documents, so a heading
may be ``## 2. Title``, ``2. Title`` alone between blank lines or ``📌 Title``, and a key
may be ``**key:** value``, ``**key**: value`` or ``key: value``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from docloom.functions import block_lines


def _part(value: Column, pattern: str, group: int = 1) -> Column:
    """What a group of a pattern matched; null if it did not, or matched nothing."""
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def link(value: Column) -> Column:
    """The first address in a text, whether bare or behind ``[name](address)``."""
    return _part(value, r"(https?://[^\s)\]>]+)")


def _parsed(docs: DataFrame, key: list[str], text: str) -> tuple[DataFrame, StructType, StructType]:
    rows = docs.select(*key, F.col(text).alias("_text"))
    return rows, StructType(rows.schema.fields[:-1]), StructType.fromDDL(block_lines.BLOCK_SQL)


def blocks(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One row for each line that is not blank and no table's header or alignment row.

    ``line_no``; ``kind``: heading, item, point (``n.m text``), row, rule, quote or text; ``level`` of a
    heading, depth of an item from 0; ``number`` of a heading, item or point; ``content``
    without the marks of its kind; ``checked`` of an item with a check box, else null;
    ``label`` and ``value`` of a key and its value (the value null if empty or a placeholder) or
    of a line that begins with a bold term, then with ``ipa`` (between slashes), ``aside`` (in
    parentheses) and the rest as ``value``; ``table_no`` and ``cells`` (name of the header, value) of
    a row; ``path``, the titles of the headings above; ``parent``, the line number of the item
    above, for items and quotes; ``fields`` of an item at the margin, the blocks right under it in order.

    A null or empty text has no block.  Each row is a document by itself, parsed in the
    batch that it lies in: nothing is shuffled.
    """
    rows, keys, block = _parsed(docs, key, text)
    return rows.mapInArrow(block_lines.block_rows, StructType(keys.fields + block.fields))


def listed(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One row for each document with its ``blocks`` as a list, for work that needs those of a document side by side."""
    rows, keys, block = _parsed(docs, key, text)
    return rows.mapInArrow(block_lines.block_lists, StructType([*keys.fields, StructField("blocks", ArrayType(block))]))


def gathered(rows: DataFrame, key: list[str]) -> DataFrame:
    """Documents with their ``blocks`` as a list in order: ``rows`` itself if it is such, else its blocks brought together by ``key``."""
    if "blocks" in rows.columns:
        return rows
    names = [n for n in rows.columns if n not in key]
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*names)), lambda a, b: a["line_no"] - b["line_no"]).alias("blocks"))


def pick(rows: DataFrame, key: list[str], fits: Callable[[Column], Column], make: Callable[[Column], Column]) -> DataFrame:
    """``make`` (a struct) of each block that ``fits``, from blocks as rows or as lists."""
    if "blocks" in rows.columns:
        return rows.select(*key, F.inline(F.transform(F.filter("blocks", fits), make)))
    block = F.struct(*[n for n in rows.columns if n not in key])
    return rows.where(fits(block)).select(*key, F.inline(F.array(make(block))))


def cell(name: str, block: Column | None = None) -> Column:
    """The value of the first cell whose header matches ``name``, a pattern; null if there is none or it is empty."""
    return F.get(F.filter("cells" if block is None else block["cells"], lambda c: c["name"].rlike(f"(?i){name}")), F.lit(0))["value"]


def under(title: str, block: Column | None = None) -> Column:
    """Whether a block stands under a heading that matches ``title``, a pattern."""
    return F.exists("path" if block is None else block["path"], lambda t: t.rlike(f"(?i){title}"))


def children(rows: DataFrame, key: list[str]) -> DataFrame:
    """Each item at the margin (``line_no``, ``content``, ``label``, ``value``, ``ipa``, ``aside``, ``path``) with ``fields``: label, value and text of the blocks under it, in order.

    Items without any keep an empty list.
    """
    return rows.where("kind = 'item' AND parent IS NULL").select(*key, "line_no", "content", "label", "value", "ipa", "aside", "path", "fields")


def field(*patterns: str) -> Column:
    """The value of the first of ``fields`` whose label matches the first pattern and none of the others."""
    first, others = patterns[0], patterns[1:]

    def fits(f: Column) -> Column:
        ok = f["label"].rlike(f"(?i){first}")
        for other in others:
            ok = ok & ~f["label"].rlike(f"(?i){other}")
        return ok

    return F.get(F.filter("fields", fits), F.lit(0))["value"]


def parts(rows: DataFrame, key: list[str], title: str, fields: dict[str, tuple[str, ...]], cells: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """Items at the margin, and rows of tables if there are ``cells``, under a heading that matches ``title``, with their named parts.

    ``kind``, ``label``, ``value``, ``ipa`` and ``aside`` as in ``blocks``; ``its_n`` for each name n: of
    an item what ``field`` gives for ``fields[n]``, of a row what ``cell`` gives for ``cells[n]``, null
    if n is not among them.  Patterns are in lower case.  ``rows`` are blocks, or documents with a
    ``text``: then only these lines are read and only what is returned leaves the batch.
    """
    cells = cells or {}
    names = [f"its_{n}" for n in {**fields, **cells}]
    if "path" not in rows.columns:
        docs, keys, _ = _parsed(rows, key, text)
        made = StructType([StructField(n, StringType()) for n in [*block_lines.PARTS, *names]])
        return docs.mapInArrow(partial(block_lines.part_rows, title=title, fields=fields, cells=cells), StructType(keys.fields + made.fields))
    row, item, null = F.col("kind") == "row", (F.col("kind") == "item") & F.col("parent").isNull(), F.lit(None).cast("string")
    of = lambda n: F.when(row, cell(cells[n]) if n in cells else null).otherwise(field(*fields[n]) if n in fields else null).alias(f"its_{n}")
    return rows.where(((row | item) if cells else item) & under(title)).select(*key, *block_lines.PARTS, *[of(n) for n in {**fields, **cells}])
