"""Queries over crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.plans.support import Query, sql_fixture, table
from docloom.sources import io

TEMPLATE = "Summarise the page.\n"
#: Pages with links in all quotings, odd white space, and urls that are missing, malformed or without a scheme.
ODD_PAGES = """SELECT page_id, CASE page_id % 9 WHEN 3 THEN NULL WHEN 5 THEN 'no/scheme' WHEN 7 THEN 'http://a b/%zz' ELSE url END AS url,
 replace(html, '</body>', concat('<a class="x" href=', chr(39), '/one/', page_id, chr(39), '>1</a>\u3000\u00a0<A title="a > b" data-href="/no" HREF = /two/', page_id, '?q=1>2</a>\x0b\u2003<a href="//cdn/x">3</a>\x85<a\nhref="/">4</a> <b href="/b">5</b>\u3000</body>')) AS html FROM {pages}"""


def src1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").alias("html_chars"))


def src1_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a status of their fetch (by id: most succeed); failed ones give their reason and no html."""
    status = F.element_at(F.array(F.lit(200), F.lit(200), F.lit(404), F.lit(204), F.lit(503), F.lit(None).cast("int")), (F.col("page_id") % 6 + 1).cast("int"))
    rows = io.fetched(table(spark, sf_dir, "pages").withColumn("status", status))
    return rows.select("page_id", "failure", F.when(F.col("failure").isNull(), F.length("html")).alias("html_chars"))


def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_fixture(spark, sf_dir, ODD_PAGES, pages="pages")


def txt1_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.body_of(F.col("html")).alias("body"))


def txt2_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _odd(spark, sf_dir).select("page_id", text.compact(text.body_of(F.col("html"))).alias("body"))


def txt3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _odd(spark, sf_dir).select("page_id", text.absolute_links(text.body_of(F.col("html")), F.col("url")).alias("body"))


def txt4_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies cut at 30,000 characters; every fifth page is written ten times over, so that some are longer."""
    limit = 30_000
    body = F.when(F.col("page_id") % 5 == 0, F.repeat(text.body_of(F.col("html")), F.lit(10))).otherwise(text.body_of(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", text.truncate(body, limit).alias("body"), (F.length(body) > limit).alias("truncated"))


def txt6_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = text.body_of(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("raw_chars"), F.length(body).alias("body_chars"), F.length(text.compact(body)).alias("compact_chars"))


def txt7_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.prompt_prefix(F.lit(TEMPLATE), text.compact(text.body_of(F.col("html")))).alias("prompt"))


def txt13_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", text.base_name(bare).alias("base_name"), text.swap_extension(bare, "_transcript.txt").alias("transcript"))


def page_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body, absolute links, compaction and the input limit, in one projection over the scan."""
    body = text.absolute_links(text.body_of(F.col("html")), F.col("url"))
    compact = text.compact(body)
    return table(spark, sf_dir, "pages").select("page_id", "url", text.truncate(compact).alias("body"), (F.length(compact) > 30_000).alias("truncated"))


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host: pages, anchors and the share of characters that preparation keeps."""
    pages = page_prepare(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("raw")), "page_id")
    host = F.parse_url("url", F.lit("HOST"))
    links = F.regexp_count("body", F.lit(r"<a\b"))
    return pages.groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.sum(links).cast("long").alias("links"), F.round(F.sum(F.length("body")) / F.sum("raw"), 6).alias("kept_ratio"))


_BASE = r"regexp_extract(url, '^([a-z]+://[^/?#\s]+)(?:[/?#]|$)', 1)"
_CLEAN = r"regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g')"
_BODY = rf"CASE WHEN regexp_matches({_CLEAN}, '(?i)<body\b') THEN regexp_extract({_CLEAN}, '(?is)<body\b[^>]*>(.*?)(</body\s*>|\z)', 1) ELSE html END"
_COMPACT = rf"trim(regexp_replace(b, '[\x09-\x0d\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"
_LINKS = "b"
for _value in (r'")(/[^/"][^"]*"|/")', r"')(/[^/'][^']*'|/')", r""")(/[^/\s"'>][^\s"'>]*)"""):
    _pattern = (r"""(?i)(<a(?:[^>"']|"[^"]*"|'[^']*')*?[\s/]href\s*=\s*""" + _value).replace("'", "''")
    _LINKS = rf"regexp_replace({_LINKS}, '{_pattern}', '\1' || {_BASE} || '\2', 'g')"
_LINKS = f"CASE WHEN coalesce({_BASE}, '') = '' THEN b ELSE {_LINKS} END"
_BODIES = f"WITH x AS (SELECT page_id, url, html, {_BODY} AS b FROM pages) "
_ODD_BODIES = f"WITH p AS ({ODD_PAGES.format(pages='pages')}), x AS (SELECT page_id, url, html, {_BODY} AS b FROM p) "
_PREPARED = f"WITH x AS (SELECT page_id, url, html, {_BODY} AS b FROM pages), y AS (SELECT page_id, url, html, {_LINKS} AS b FROM x), z AS (SELECT page_id, url, html, {_COMPACT} AS c FROM y) "

QUERIES: dict[str, Query] = {f.__name__: f for f in (src1_pages, src1_status, txt1_body, txt2_compact, txt3_links, txt4_truncate, txt6_lengths, txt7_prompt, txt13_names, page_prepare, page_hosts)}
ORACLES = {
    "src1_pages": "SELECT page_id, url, length(html)::INTEGER AS html_chars FROM pages",
    "src1_status": "SELECT page_id, CASE page_id % 6 WHEN 2 THEN 'HTTP 404' WHEN 4 THEN 'HTTP 503' WHEN 5 THEN 'no response' END AS failure, CASE WHEN page_id % 6 IN (0, 1, 3) THEN length(html)::INTEGER END AS html_chars FROM pages",
    "txt1_body": _BODIES + "SELECT page_id, b AS body FROM x",
    "txt2_compact": _ODD_BODIES + f"SELECT page_id, {_COMPACT} AS body FROM x",
    "txt3_links": _ODD_BODIES + f"SELECT page_id, {_LINKS} AS body FROM x",
    "txt4_truncate": _BODIES + ", y AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN repeat(b, 10) ELSE b END AS b FROM x) SELECT page_id, substring(b, 1, 30000) AS body, length(b) > 30000 AS truncated FROM y",
    "txt6_lengths": _BODIES + f"SELECT page_id, length(html)::INTEGER AS raw_chars, length(b)::INTEGER AS body_chars, length({_COMPACT})::INTEGER AS compact_chars FROM x",
    "txt7_prompt": _BODIES + f"SELECT page_id, 'Summarise the page.' || chr(10) || {_COMPACT} AS prompt FROM x",
    "txt13_names": r"WITH x AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages) SELECT page_id, list_extract(string_split(u, '/'), -1) AS base_name, regexp_replace(u, '\.[^./]+$', '_transcript.txt') AS transcript FROM x",
    "page_prepare": _PREPARED + "SELECT page_id, url, substring(c, 1, 30000) AS body, length(c) > 30000 AS truncated FROM z",
    "page_hosts": _PREPARED + r"SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, count(*) AS pages, sum(len(regexp_extract_all(substring(c, 1, 30000), '<a\b')))::BIGINT AS links, round(sum(length(substring(c, 1, 30000)))::DOUBLE / sum(length(html)), 6) AS kept_ratio FROM z GROUP BY 1",
}
