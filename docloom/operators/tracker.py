"""Study trackers: typed rows, rollups, weighted progress, checks, gaps and syncing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import blocks as md

# The weight of each domain in the exam, and its chapters.
WEIGHTS = (15, 10, 13, 13, 13, 12, 13, 11)
CHAPTERS = ((1, 4), (5, 5), (6, 10), (11, 12), (13, 14), (15, 15), (16, 19), (20, 21))
HIGH_RISK = ("D1", "D3", "D4", "D7")


def domains(spark) -> DataFrame:
    return spark.createDataFrame([(f"D{i + 1}", w, lo, hi) for i, (w, (lo, hi)) in enumerate(zip(WEIGHTS, CHAPTERS, strict=True))], "domain string, weight int, lo int, hi int")


def typed_rows(rows: DataFrame, key: str) -> DataFrame:
    """Domain rows and the chapter rows under them, from the tables among the blocks of trackers.

    ``rows`` are blocks as rows or, where no shuffle is wanted, as lists (``blocks.listed``).
    Cells count by their header, wherever it stands: domain or chapter, weight, progress
    (``n/m``), mastery (percent) and status.  A domain row begins with ``D`` and a number; a chapter
    row (``Ch n: title (`file`)``) takes the domain of the row above it in its table.
    What is missing or a placeholder is null; a chapter is done if its status says so.
    """
    part = lambda c, p, g=1: F.nullif(F.regexp_extract(c, p, g), F.lit(""))
    read = lambda b: F.struct(b["table_no"].alias("table_no"), *[md.cell(p, b).alias(n) for n, p in (("name", "domain|chapter"), ("weight", "weight"), ("progress", "progress"), ("mastery", "mastery"), ("status", "status"))])
    of = lambda r: part(r["name"], r"^(D\d+)\b")
    # the rows of a tracker lie side by side in their list: the domain is handed down from row to row
    start = F.struct(F.lit(None).cast("bigint").alias("table_no"), F.lit(None).cast("string").alias("domain"), F.array().cast("array<string>").alias("all"))

    def hand_down(held: Column, r: Column) -> Column:
        domain = F.coalesce(of(r), F.when(held["table_no"] == r["table_no"], held["domain"]))
        return F.struct(r["table_no"].alias("table_no"), domain.alias("domain"), F.concat(held["all"], F.array(domain)).alias("all"))

    docs = md.gathered(rows, [key]).select(key, F.inline(F.array(F.struct(F.transform(F.filter("blocks", lambda b: b["kind"] == "row"), read).alias("r")))))
    found = docs.select(key, F.inline(F.zip_with("r", F.aggregate("r", start, hand_down, lambda held: held["all"]), lambda r, d: r.withField("domain", d))))
    found = found.withColumns({"own": part(F.col("name"), r"^(D\d+)\b"), "chapter": part(F.col("name"), r"^[-*]?\s*Ch\.?\s*(\d+)\b").cast("int")}).where("own IS NOT NULL OR chapter IS NOT NULL")
    share = r"(\d+)\s*/\s*(\d+)"
    return found.select(
        key, "domain", "chapter", F.trim(F.regexp_replace(F.regexp_replace("name", r"^[-*]?\s*(?:D\d+|Ch\.?\s*\d+)\s*:?\s*", ""), r"\s*\(`[^`]*`\)\s*$", "")).alias("title"), part(F.col("name"), "`([^`]*)`").alias("file"),
        part(F.col("weight"), r"(\d+)\s*%").cast("int").alias("weight"), part(F.col("progress"), share).cast("int").alias("finished"), part(F.col("progress"), share, 2).cast("int").alias("parts"),
        part(F.col("mastery"), r"(\d+)\s*%").cast("int").alias("stated"), "status", F.coalesce(F.col("status").rlike("(?i)completed|✅"), F.lit(False)).alias("done"),
    )


def stated_overall(rows: DataFrame, key: str) -> DataFrame:
    """The overall percentage that each tracker states (``Overall Progress: n%``); the first one counts."""
    percent = F.nullif(F.regexp_extract("value", r"(\d+)\s*%", 1), F.lit("")).cast("int")
    said = md.pick(rows, [key], lambda b: b["label"].rlike("(?i)overall progress"), lambda b: F.struct(b["line_no"].alias("line_no"), b["value"].alias("value")))
    return said.groupBy(key).agg(F.min_by(percent, "line_no").alias("stated"))


def rollup(rows: DataFrame, key: str) -> DataFrame:
    """Finished share of each chapter, domain and of the whole, by one rollup."""
    return rows.where("chapter IS NOT NULL").select(key, "domain", "chapter", F.col("done").cast("int").alias("d")).rollup(key, "domain", "chapter").agg(F.sum("d").alias("done"), F.count("*").alias("chapters"), F.grouping_id().alias("level")).where(f"{key} IS NOT NULL")


def weighted(rows: DataFrame, key: str, domains_: DataFrame) -> DataFrame:
    """Progress in percent: each domain's finished share by its weight."""
    per = rows.where("chapter IS NOT NULL").groupBy(key, "domain").agg(F.avg(F.col("done").cast("double")).alias("share"))
    return per.join(F.broadcast(domains_.select("domain", "weight")), "domain").groupBy(key).agg(F.round(F.sum(F.col("weight") * F.col("share")), 4).alias("progress"))


def inconsistent(rows: DataFrame, key: str) -> DataFrame:
    """Stated against derived percent of each domain row."""
    derived = rows.where("chapter IS NOT NULL").groupBy(key, "domain").agg(F.floor(100 * F.avg(F.col("done").cast("double")) + 1e-9).cast("int").alias("derived"))
    stated = rows.where("chapter IS NULL").select(key, "domain", "stated")
    return stated.join(derived, [key, "domain"]).withColumn("difference", F.col("stated") - F.col("derived"))


def severity(domain):
    return F.when(domain.isin(*HIGH_RISK), "High").otherwise("Normal")


def with_heads(rows: DataFrame, key: str, **lists: Column) -> DataFrame:
    """Notes with a block that may tell their head, with ``head`` (see ``session_heads``) and ``lists`` made of their ``blocks``, each computed once."""
    told = F.transform(F.filter("blocks", lambda b: md.under("overview", b) | (F.size(b["path"]) <= 1)), lambda b: F.struct(b["label"].alias("label"), b["value"].alias("value")))
    docs = md.gathered(rows, [key]).select(key, F.inline(F.array(F.struct(told.alias("told"), *[c.alias(n) for n, c in lists.items()])))).where(F.size("told") > 0)
    first = lambda p: F.get(F.filter("told", lambda b: b["label"].rlike(f"(?i)^(?:{p})")), F.lit(0))["value"]
    number = lambda c: F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit(""))
    day = F.regexp_extract(first("date"), r"^\d{4}-\d{2}-\d{2}$", 0)
    chapter = number(F.regexp_replace(first(".*chapter"), r"^.*?(?:Chapter|Ch\.?)\s*", "")).cast("int")
    head = F.struct(number(first("learner")).cast("long").alias("learner_id"), F.nullif(day, F.lit("")).alias("day"), first("duration").alias("duration"), chapter.alias("chapter"), first("resource").alias("file"), first(".*domain").alias("domain"))
    return docs.select(key, head.alias("head"), *lists)


def session_heads(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """Of each note: learner, day, duration, chapter (the first one named), file and domain; placeholders and what is missing are null."""
    return with_heads(rows, key).select(key, "head.*")


def _kind(b: Column) -> Column:
    return F.when(md.under("gaps identified", b), "gap").when(md.under("mastered today", b), "mastered")


def is_finding(b: Column) -> Column:
    return (b["kind"] == "row") & _kind(b).isNotNull()


def _finding(b: Column) -> Column:
    own = F.nullif(F.regexp_extract(md.cell("chapter", b), r"(\d+)", 1), F.lit("")).cast("int")
    return F.struct(_kind(b).alias("kind"), md.cell("topic", b).alias("topic"), own.alias("own"), F.coalesce(md.cell("severity", b), md.cell("confidence", b)).alias("grade"), md.cell("notes", b).alias("notes"))


def findings_of(blocks: Column) -> Column:
    """The gap and mastered rows among a note's blocks, as structs."""
    return F.transform(F.filter(blocks, is_finding), _finding)


def session_findings(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """Gap and mastered rows of the notes' tables: kind, topic, chapter, severity or confidence, notes.

    The heading above a table tells its kind.  A row without a chapter of its own takes
    the one of its note; a topic that is a placeholder is null.  ``rows`` are blocks as rows or,
    where no shuffle is wanted, as lists (``blocks.listed``).
    """
    found = with_heads(rows, key, found=findings_of(F.col("blocks"))).select(key, "head", F.inline("found"))
    return found.select(key, "head.learner_id", "head.day", "kind", "topic", F.coalesce("own", "head.chapter").alias("chapter"), "grade", "notes")


def is_topic(b: Column) -> Column:
    return md.under("learning log", b) & (b["kind"] == "item")


def session_topics(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """The logged statements of each topic: topic, label, value and whether it stands under another item, in order of ``line_no``; unanswered ones have a null value."""
    topic = lambda b: F.regexp_replace(F.element_at(b["path"], -1), r"^Topic\s*\d+\s*:\s*", "")
    return md.pick(rows, [key], is_topic, lambda b: F.struct(b["line_no"].alias("line_no"), topic(b).alias("topic"), b["label"].alias("label"), b["value"].alias("value"), b["parent"].isNotNull().alias("nested")))


def is_action(b: Column) -> Column:
    return b["checked"].isNotNull()


def action_items(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """Items with a check box: label, value (null for a placeholder), done."""
    return md.pick(rows, [key], is_action, lambda b: F.struct(*[b[n].alias(n) for n in ("line_no", "label", "value")], b["checked"].alias("done")))


def concepts(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """Concepts and their definitions; placeholders go."""
    return rows.where(md.under("concepts") & F.col("value").isNotNull()).select(key, F.col("label").alias("concept"), F.col("value").alias("definition"))


def sync(rows: DataFrame) -> DataFrame:
    """The latest state of each learner's chapters; on one day a gap outweighs mastery."""
    order = F.struct("day", (F.col("kind") == "gap").cast("int"))
    return rows.where("kind IS NOT NULL AND chapter IS NOT NULL").groupBy("learner_id", "chapter").agg(F.max_by("kind", order).alias("state"), F.max("day").alias("day"))
