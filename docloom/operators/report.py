"""Reports: flattening, rendering, digests, headlines, contract checks and categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The texts of a rendered report.
HEADING, CATEGORY_MARK, LINKS_MARK = "# AI 日报\n\n", "## 📰 ", "**相关链接:** "
NO_CATEGORY, NO_TITLE, NO_CONTENT, NO_LINK = "未知分类", "无标题", "无摘要", "链接"
OTHER = "其他"


def flatten_items(reports: DataFrame, key: str, report: str = "report") -> DataFrame:
    """One row per item: key, positions and texts of category and item."""
    cats = reports.select(key, F.posexplode(report).alias("cat_pos", "c"))
    return cats.select(key, "cat_pos", F.col("c.category").alias("category"), F.posexplode("c.items").alias("item_pos", "i")).select(key, "cat_pos", "category", "item_pos", F.col("i.title").alias("title"), F.col("i.content").alias("content"), F.col("i.links").alias("links"))


def flatten_links(reports: DataFrame, key: str, report: str = "report") -> DataFrame:
    """One row per link; an item without links has one row with nulls."""
    items = flatten_items(reports, key, report)
    return items.select(key, "cat_pos", "category", "item_pos", "title", F.posexplode_outer("links").alias("link_pos", "l")).select(key, "cat_pos", "category", "item_pos", "title", "link_pos", F.col("l.text").alias("link_text"), F.col("l.url").alias("link_url"))


def render(report: Column) -> Column:
    """A report as Markdown, row-local whatever its size."""
    def link(x: Column) -> Column:
        text = F.coalesce(x["text"], F.lit(NO_LINK))
        bare = (F.coalesce(x["url"], F.lit("#")) == "#") | (x["url"] == "")
        return F.when(bare, text).otherwise(F.concat(F.lit("["), text, F.lit("](<"), x["url"], F.lit(">)")))

    def item(x: Column) -> Column:
        links = F.when(F.size(x["links"]) > 0, F.concat(F.lit(LINKS_MARK), F.array_join(F.transform(x["links"], link), " | "), F.lit("\n\n"))).otherwise("")
        return F.concat(F.lit("### "), F.coalesce(x["title"], F.lit(NO_TITLE)), F.lit("\n"), F.coalesce(x["content"], F.lit(NO_CONTENT)), F.lit("\n\n"), links)

    def category(x: Column) -> Column:
        return F.concat(F.lit(CATEGORY_MARK), F.coalesce(x["category"], F.lit(NO_CATEGORY)), F.lit("\n\n"), F.array_join(F.transform(x["items"], item), ""))

    return F.concat(F.lit(HEADING), F.array_join(F.transform(report, category), ""))


def counts(report: Column) -> dict[str, Column]:
    items = F.flatten(F.transform(report, lambda c: c["items"]))
    return {"categories": F.size(report), "items": F.size(items), "links": F.aggregate(items, F.lit(0), lambda n, i: n + F.greatest(F.size(i["links"]), F.lit(0)))}


def top_k(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; ``order`` must break ties.  Spark cuts each task's rows to k before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def digest(points: DataFrame, group: str, *, k: int = 20, limit: int = 300) -> DataFrame:
    """The best points of each group while their texts stay within ``limit`` characters; rows are (group, id, score, text)."""
    best = top_k(points, [group], [F.desc("score"), F.asc("id")], k)
    running = Window.partitionBy(group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    best = best.withColumn("chars", F.sum(F.length("text")).over(running)).where(F.col("chars") <= limit)
    return best.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("points")).select(group, F.array_join(F.transform("points", lambda p: p["text"]), "").alias("digest"), F.size("points").cast("long").alias("n_points"))


def headline(points: DataFrame, group: str, *, k: int = 3, least: int = 60, most: int = 80) -> DataFrame:
    """The best ``k`` points of each group joined by ``；``, and whether that keeps the length contract."""
    best = top_k(points, [group], [F.desc("score"), F.asc("id")], k)
    out = best.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("points"))
    title = F.array_join(F.transform("points", lambda p: p["text"]), "；")
    return out.select(group, title.alias("headline"), ((F.size("points") >= k) & F.length(title).between(least, most)).alias("within_contract"))


def contract(observed: DataFrame, key: str, rules: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """One row per key and rule: observed value and whether it lies in the rule's bounds; null fails."""
    lines = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("observed"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for n, (lo, hi) in rules.items()])
    ok = F.coalesce((F.col("r.lo").isNull() | (F.col("r.observed") >= F.col("r.lo"))) & (F.col("r.hi").isNull() | (F.col("r.observed") <= F.col("r.hi"))), F.lit(False))
    return observed.select(key, F.explode(lines).alias("r")).select(key, "r.rule", "r.observed", ok.alias("pass"))


def assign_category(docs: DataFrame, key: str, text: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """The category with most keyword hits in a text (ties: first by name), ``其他`` without a hit.

    Rules are a short parameter, so hits are counted by one expression per keyword, without a join.
    """
    words = F.split(F.lower(F.col(text)), r"[^\p{L}]+")
    names = sorted({c for _, c in rules})
    hits = {c: F.size(F.filter(words, _among([k for k, cat in rules if cat == c]))) for c in names}
    best = F.array_max(F.array(*[F.struct(hits[c].alias("hits"), F.lit(-i).alias("order"), F.lit(c).alias("category")) for i, c in enumerate(names)]))
    return docs.select(key, best.alias("b")).select(key, F.when(F.col("b.hits") > 0, F.col("b.category")).otherwise(OTHER).alias("category"), F.col("b.hits").cast("long").alias("hits"))


def _among(words: list[str]):
    return lambda w: w.isin(words)
