"""Queries over model responses and the reports in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import jsonx
from docloom.operators import report
from docloom.plans.support import Query, cte, once, table

_LINK = """CASE doc_id % 7 WHEN 0 THEN '#' WHEN 1 THEN '' ELSE 'http://h/' || (doc_id % 7) END"""
ARRAY = f"""'[{{"category":"' || source || '","items":[{{"title":"T' || doc_id || '","content":"' || lang || '","links":[{{"text":"L","url":"' || {_LINK} || '"}}]}}]}}]'"""
OBJECT = """'{"title":"T' || doc_id || '","tags":["a","' || lang || '"]}'"""
RESPONSES = f"""SELECT doc_id AS resp_id, CASE doc_id % 8
 WHEN 0 THEN a WHEN 1 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || a || chr(10) || '```' || chr(10) || 'Done.'
 WHEN 2 THEN 'Here:' || chr(10) || '```' || chr(10) || a || chr(10) || '```' WHEN 3 THEN 'The answer is ' || o || ' as asked.'
 WHEN 4 THEN '{{"note":"x","report":' || a || '}}' WHEN 5 THEN 'No data today.' WHEN 6 THEN left(a, length(a) - 3)
 ELSE a || ' That is all.' END AS content, a, o, lang, source FROM (SELECT doc_id, lang, source, {ARRAY} AS a, {OBJECT} AS o FROM {{documents}}) s"""
_ESCAPED = "concat('\"', replace(replace(replace(content, chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34))), chr(10), concat(chr(92), 'n')), '\"')"
ENVELOPES = """SELECT resp_id, content, CASE resp_id % 11 WHEN 0 THEN '{"choices":[]}' WHEN 1 THEN '{"choices":[{"message":{"content":null}}]}'
 WHEN 2 THEN '{"choices":[{"message":{"content":""}}]}' ELSE concat('{"choices":[{"message":{"content":', ESCAPED, '}}]}') END AS body,
 CASE resp_id % 9 WHEN 0 THEN '{"response":"Error: Not a valid JSON"}' WHEN 1 THEN '{}' ELSE concat('{"response":', ESCAPED, '}') END AS local_body,
 CASE resp_id % 6 WHEN 0 THEN '{"objects":[]}' WHEN 1 THEN '{"objects":[{"text":"t"}]}' WHEN 2 THEN '{"objects":[{"title":"x"}]}'
 ELSE concat('{"objects":[{"title":"', source, '","text":', ESCAPED, '}]}') END AS article_body FROM (RESPONSES) r""".replace("ESCAPED", _ESCAPED).replace("RESPONSES", RESPONSES)
BROKEN = """SELECT doc_id AS resp_id, concat('[{', CASE WHEN doc_id % 10 = 1 THEN '' ELSE '"category":"c",' END, CASE doc_id % 10 WHEN 2 THEN '"x":1' WHEN 3 THEN '"items":[]' WHEN 4 THEN '"items":"x"'
 ELSE concat('"items":[{"title":', CASE WHEN doc_id % 10 = 8 THEN 'null' ELSE '"t"' END, CASE WHEN doc_id % 10 = 5 THEN '' ELSE ',"content":"c"' END, ',"links":', CASE doc_id % 10 WHEN 6 THEN '{}' WHEN 9 THEN '[]' WHEN 7 THEN '[{"text":"l"}]' ELSE '[{"text":"l","url":null}]' END, '}]') END, '}]') AS content FROM {documents}"""


def _spark(sql: str) -> str:
    """The fixture over a view of the table."""
    return sql.replace("{documents}", "documents_view")


def _rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents_view")
    # Spark reads a backslash in a string literal as an escape, DuckDB does not: the SQL uses chr(92)
    return spark.sql(_spark(sql))


def _twin(sql: str) -> str:
    return sql.replace("{documents}", "documents")


def _recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(_rows(spark, sf_dir, RESPONSES), ["resp_id", "lang"], found=F.struct(F.col("content").alias("content"), jsonx.embedded(F.col("content")).alias("inner")))
    json, stage = jsonx.recover(F.col("found.content"), F.col("found.inner"))
    return once(rows, ["resp_id", "lang"], json=json, stage=stage)


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain from responses to checked reports; each step is computed once."""
    rows = once(_recovered(spark, sf_dir), ["resp_id"], json=jsonx.unwrap_report(F.col("json"))).where("json IS NOT NULL")
    rows = once(rows, ["resp_id", "json"], fault=jsonx.report_fault(F.col("json"))).where("fault IS NULL")
    return once(rows, ["resp_id"], report=jsonx.report(F.col("json")))


def jsn1_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recovered(spark, sf_dir).select("resp_id", "json", "stage")


def jsn2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, RESPONSES).select("resp_id", jsonx.strip_fence(F.col("content")).alias("json"))


def jsn3_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(_rows(spark, sf_dir, RESPONSES), ["resp_id"], json=jsonx.strip_fence(F.col("content")))
    return rows.select("resp_id", jsonx.unwrap_report(F.col("json")).alias("report"))


def jsn4_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recovered(spark, sf_dir).select("resp_id", jsonx.title_object(F.col("json")).alias("entry"))


def jsn5_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    content, status = jsonx.response_content(F.col("body"))
    return _rows(spark, sf_dir, ENVELOPES).select("resp_id", content.alias("content"), status.alias("status"))


def jsn6_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, error = jsonx.local_response(F.col("local_body"))
    return _rows(spark, sf_dir, ENVELOPES).select("resp_id", value.alias("response"), error.alias("looks_like_error"))


def jsn7_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    fault = jsonx.report_fault(F.col("content"))
    rows = once(_rows(spark, sf_dir, BROKEN), ["resp_id"], reason=fault)
    return rows.select("resp_id", F.col("reason").isNull().alias("valid"), "reason")


def jsn8_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.flatten_links(_reports(spark, sf_dir), "resp_id")


def jsn9_serialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of each day's index, in the field order of either variant."""
    rows = _rows(spark, sf_dir, RESPONSES)
    tags = F.array(F.lit("a"), F.col("lang"))
    title = F.concat(F.lit("T"), F.col("resp_id"))
    date = F.lit("2024-01-31")
    full = F.to_json(F.struct(date.alias("date"), title.alias("title"), tags.alias("tags")))
    short = F.to_json(F.struct(title.alias("title"), tags.alias("tags"), date.alias("date")))
    return rows.select("resp_id", F.when(F.col("resp_id") % 2 == 0, full).otherwise(short).alias("entry"))


def src2_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, text, status = jsonx.article(F.col("article_body"))
    return _rows(spark, sf_dir, ENVELOPES).select("resp_id", title.alias("title"), text.alias("text"), status.alias("status"))


def agg1_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir).select("resp_id", report.render(F.col("report")).alias("markdown"))


def agg2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir).select("resp_id", *[c.alias(n) for n, c in report.counts(F.col("report")).items()])


def agg3_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(_recovered(spark, sf_dir), ["resp_id"], entry=jsonx.title_object(F.col("json"))).where("entry IS NOT NULL")
    return rows.select("resp_id", F.array_join(F.from_json("entry", "title string, tags array<string>")["tags"], ", ").alias("tags"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest line with words of each whole document, scored by its characters; ties go to the smaller line."""
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x: F.struct(F.length(x).alias("n"), x.alias("l")))
    return table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"), F.col("n_chars").alias("score"), F.array_min(lines)["l"].alias("text"))


def agg8_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.digest(_points(spark, sf_dir), "source")


def agg9_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.headline(_points(spark, sf_dir), "source")


RULES = {"items": (20, None), "longest_content": (None, 150), "n_tags": (4, 6), "title_chars": (60, 80), "digest_chars": (None, 300), "vocabulary": (15, None), "phrases": (10, None)}


def agg10_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of each source's output, taken from its documents."""
    words = F.size(F.array_distinct(F.split("text", " ")))
    observed = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("items"), F.max(F.length("text")).alias("longest_content"), F.count_distinct("lang").alias("n_tags"), F.min(F.length("text")).alias("title_chars"),
        F.min(F.length("text")).alias("digest_chars"), F.max(words).alias("vocabulary"), F.min(words).alias("phrases"),
    )
    return report.contract(observed, "source", RULES)


KEYWORDS = (("the", "english"), ("and", "english"), ("der", "german"), ("und", "german"), ("la", "romance"), ("de", "romance"))


def agg11_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.assign_category(table(spark, sf_dir, "documents"), "doc_id", "text", KEYWORDS)


def json_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery, checking and flattening in one plan: links per category."""
    return report.flatten_links(_reports(spark, sf_dir), "resp_id").groupBy("category").agg(F.count("*").alias("links"), F.count_distinct("link_url").alias("urls"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (src2_article, jsn1_recover, jsn2_clean, jsn3_unwrap, jsn4_title, jsn5_content, jsn6_local, jsn7_validate, jsn8_flatten, jsn9_serialise, agg1_render, agg2_counts, agg3_tags, agg8_digest, agg9_headline, agg10_contract, agg11_category, json_chain)
}
_R = cte(r=_twin(RESPONSES))
_E = cte(e=_twin(ENVELOPES))
_WITH_REPORT = "resp_id % 8 IN (0, 1, 2, 4, 7)"
_URL = "CASE resp_id % 7 WHEN 0 THEN '#' WHEN 1 THEN '' ELSE 'http://h/' || (resp_id % 7) END"
# a report in an array with prose comes back as its one object, which holds no list
_HAS = "resp_id % 8 IN (0, 1, 2, 4)"
_TOP = "WITH x AS (SELECT source, doc_id, n_chars, list_sort(list_transform(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> ''), lambda l: {{'n': length(l), 'l': l}}))[1].l AS t, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) "
_WORDS = "len(list_distinct(string_split(text, ' ')))"
_HITS = "len(list_filter(w, lambda x: x IN ({})))"
ORACLES = {
    "src2_article": _E + "SELECT resp_id, CASE WHEN resp_id % 6 = 0 THEN NULL WHEN resp_id % 6 = 1 THEN '无标题' WHEN resp_id % 6 = 2 THEN 'x' ELSE d.source END AS title, CASE resp_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 't' WHEN 2 THEN '' ELSE content END AS text, CASE resp_id % 6 WHEN 0 THEN 'extract_failed' WHEN 2 THEN 'empty' ELSE 'ok' END AS status FROM e JOIN documents d ON d.doc_id = resp_id",
    "jsn1_recover": _R + "SELECT resp_id, CASE resp_id % 8 WHEN 3 THEN o WHEN 4 THEN content WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN substring(a, 2, length(a) - 2) ELSE a END AS json, CASE resp_id % 8 WHEN 0 THEN 'direct' WHEN 1 THEN 'json_fence' WHEN 2 THEN 'fence' WHEN 4 THEN 'direct' WHEN 3 THEN 'braces' WHEN 7 THEN 'braces' ELSE 'none' END AS stage FROM r",
    "jsn2_clean": _R + "SELECT resp_id, CASE WHEN resp_id % 8 IN (1, 2) THEN a ELSE content END AS json FROM r",
    "jsn3_unwrap": _R + f"SELECT resp_id, CASE WHEN {_HAS} THEN a END AS report FROM r",
    "jsn4_title": _R + "SELECT resp_id, CASE WHEN resp_id % 8 = 3 THEN o END AS entry FROM r",
    "jsn5_content": _E + "SELECT resp_id, CASE WHEN resp_id % 11 IN (0, 1) THEN NULL WHEN resp_id % 11 = 2 THEN '' ELSE content END AS content, CASE WHEN resp_id % 11 IN (0, 1, 2) THEN 'empty' ELSE 'ok' END AS status FROM e",
    "jsn6_local": _E + "SELECT resp_id, CASE resp_id % 9 WHEN 0 THEN 'Error: Not a valid JSON' WHEN 1 THEN NULL ELSE content END AS response, resp_id % 9 = 0 AS looks_like_error FROM e",
    "jsn7_validate": "SELECT doc_id AS resp_id, doc_id % 10 IN (0, 8, 9) AS valid, CASE doc_id % 10 WHEN 1 THEN 'keys' WHEN 2 THEN 'keys' WHEN 3 THEN 'items' WHEN 4 THEN 'items' WHEN 5 THEN 'article_keys' WHEN 6 THEN 'links' WHEN 7 THEN 'link_keys' END AS reason FROM documents",
    "jsn8_flatten": _R + f"SELECT resp_id, 0 AS cat_pos, source AS category, 0 AS item_pos, 'T' || resp_id AS title, 0 AS link_pos, 'L' AS link_text, {_URL} AS link_url FROM r WHERE {_HAS}",
    "jsn9_serialise": """SELECT doc_id AS resp_id, CASE WHEN doc_id % 2 = 0 THEN '{"date":"2024-01-31","title":"T' || doc_id || '","tags":["a","' || lang || '"]}' ELSE '{"title":"T' || doc_id || '","tags":["a","' || lang || '"],"date":"2024-01-31"}' END AS entry FROM documents""",
    "agg1_render": _R + f"SELECT resp_id, '# AI 日报' || chr(10) || chr(10) || '## 📰 ' || source || chr(10) || chr(10) || '### T' || resp_id || chr(10) || lang || chr(10) || chr(10) || '**相关链接:** ' || CASE WHEN resp_id % 7 < 2 THEN 'L' ELSE '[L](<' || {_URL} || '>)' END || chr(10) || chr(10) AS markdown FROM r WHERE {_HAS}",
    "agg2_counts": _R + f"SELECT resp_id, 1 AS categories, 1 AS items, 1 AS links FROM r WHERE {_HAS}",
    "agg3_tags": _R + "SELECT resp_id, 'a, ' || lang AS tags FROM r WHERE resp_id % 8 = 3",
    "agg8_digest": _TOP.format() + ", y AS (SELECT *, sum(length(t)) OVER (PARTITION BY source ORDER BY r) AS s FROM x WHERE r <= 20) SELECT source, string_agg(t, '' ORDER BY r) AS digest, count(*) AS n_points FROM y WHERE s <= 300 GROUP BY source",
    "agg9_headline": _TOP.format() + "SELECT source, string_agg(t, '；' ORDER BY r) AS headline, count(*) >= 3 AND length(string_agg(t, '；' ORDER BY r)) BETWEEN 60 AND 80 AS within_contract FROM x WHERE r <= 3 GROUP BY source",
    "agg10_contract": f"WITH o AS (SELECT source, count(*) AS items, max(length(text)) AS longest_content, count(DISTINCT lang) AS n_tags, min(length(text)) AS title_chars, min(length(text)) AS digest_chars, max({_WORDS}) AS vocabulary, min({_WORDS}) AS phrases FROM documents GROUP BY source), u AS ("
    + " UNION ALL ".join(f"SELECT source, '{n}' AS rule, {n}::BIGINT AS observed, {n} >= {lo if lo is not None else -1} AND {n} <= {hi if hi is not None else 10**15} AS pass FROM o" for n, (lo, hi) in RULES.items())
    + ") SELECT * FROM u",
    "agg11_category": r"WITH x AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{L}]+') AS w FROM documents), y AS (SELECT doc_id, " + _HITS.format("'the', 'and'") + " AS e, " + _HITS.format("'der', 'und'") + " AS g, " + _HITS.format("'la', 'de'") + " AS r FROM x) SELECT doc_id, CASE WHEN greatest(e, g, r) = 0 THEN '其他' WHEN e >= g AND e >= r THEN 'english' WHEN g >= r THEN 'german' ELSE 'romance' END AS category, greatest(e, g, r)::BIGINT AS hits FROM y",
    "json_chain": _R + f"SELECT source AS category, count(*) AS links, count(DISTINCT {_URL}) AS urls FROM r WHERE {_HAS} GROUP BY source",
}
