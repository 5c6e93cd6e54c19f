"""Queries over document texts, keys and small lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.plans.support import Query, table

#: Text with urls in it: documents hold none, so one of each kind is added to each.
REDACT_INPUT = "SELECT doc_id, concat('https://h.org/', doc_id, '?a=1#b ', text, ' ftp://f.net/', source, ' www.x', doc_id, '.org end') AS text FROM {documents}"
RECIPIENTS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN '' WHEN p_partkey % 5 = 2 THEN ' a@x.org , ,b' || p_partkey || '@y.org,' ELSE p_brand || ',' || p_type END AS recipients, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN 'port' ELSE ' ' || p_size || 'x' || p_partkey || ' ' END AS port FROM {part}"
TITLES = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS title, o_orderkey % 4 AS n_tags, o_orderdate AS moment FROM {orders}"
RECORDS = "SELECT d.doc_id, CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE d.source END AS record, CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE d.text END AS text FROM {documents} d"


def txt5_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(REDACT_INPUT, documents=table(spark, sf_dir, "documents"))
    return rows.select("doc_id", text.redact_urls(F.col("text")).alias("text"), text.count_urls(F.col("text")).alias("n_urls"))


def txt8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.prompt_suffix(F.col("text"), F.lit("Give a title.")).alias("prompt"))


def txt9_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template of each language, where there is one."""
    templates = spark.createDataFrame([("en", "Summarise."), ("de", "Fasse zusammen.")], "lang string, body string")
    rows = table(spark, sf_dir, "documents").join(F.broadcast(templates), "lang", "left")
    return rows.select("doc_id", text.prompt_framed(F.col("body"), "Summarise the text.", F.col("text")).alias("prompt"))


def txt10_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    system = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("You answer in "), F.col("lang")))
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(text.messages(F.col("text"), system)).alias("messages"))


def txt11_datekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    override = F.when(F.col("o_orderkey") % 10 == 0, "2020-02-29")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.date_key(F.col("o_orderdate"), override).alias("date_key"))


def txt12_timekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.time_key(F.col("ts")).alias("time_key"))


def txt14_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


def txt15_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(RECIPIENTS, part=table(spark, sf_dir, "part"))
    items = text.split_list(F.col("recipients"))
    return rows.select("id", F.size(items).alias("n"), F.array_join(items, "|").alias("items"))


def txt16_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(RECIPIENTS, part=table(spark, sf_dir, "part"))
    port = text.digits(F.col("port"))
    return rows.select("id", port.alias("port"), port.isNull().alias("failed"))


def txt17_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(TITLES, orders=table(spark, sf_dir, "orders"))
    date = text.date_key(F.col("moment"))
    tags = F.when(F.col("n_tags") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("n_tags"))).otherwise(F.array().cast("array<bigint>"))
    title = text.report_title(F.col("title"), tags, date)
    return rows.select("id", title.alias("title"), text.mail_subject(title, date).alias("subject"))


def txt18_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(RECORDS, documents=table(spark, sf_dir, "documents"))
    return rows.select("doc_id", text.input_status(F.col("record"), F.col("text")).alias("status"))


def txt19_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = text.junk_signals(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in signals.items()], text.is_junk(signals).alias("junk"))


def txt19_junk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the junk filter meets the quality labels."""
    judged = txt19_junk(spark, sf_dir).select("doc_id", "junk")
    return judged.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "junk").agg(F.count("*").alias("n"))


def txt20_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the short form, and whether each keeps to the limit of 150 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", (F.length("text") <= 150).alias("within_limit"))


_URLS = r"https?://\S+|www\.\S+|ftp://\S+"
_DATE = "strftime(moment, '%Y-%m-%d')"


def _twin(sql: str, *names: str) -> str:
    return sql.format(**{n: n for n in names})


QUERIES: dict[str, Query] = {f.__name__: f for f in (txt5_redact, txt8_suffix, txt9_framed, txt10_messages, txt11_datekey, txt12_timekey, txt14_slug, txt15_list, txt16_digits, txt17_title, txt18_status, txt19_junk, txt19_junk_accuracy, txt20_limit)}
_LISTS = f"WITH x AS ({_twin(RECIPIENTS, 'part')}), y AS (SELECT id, port, list_filter(list_transform(string_split(recipients, ','), lambda i: trim(i)), lambda i: i <> '') AS items FROM x) "
_JUNK = "SELECT doc_id, quality, length(text) AS n_len, round(length(regexp_replace(text, '[^#*$%&|!]', '', 'g'))::DOUBLE / greatest(length(text), 1), 6) AS symbol_share, round(1 - len(list_distinct(string_split(text, chr(10))))::DOUBLE / len(string_split(text, chr(10))), 6) AS repeat_share FROM {source}"
_IS_JUNK = "(n_len < 40 OR symbol_share > 0.05 OR repeat_share > 0.5)"
ORACLES = {
    "txt5_redact": f"WITH x AS ({_twin(REDACT_INPUT, 'documents')}) SELECT doc_id, regexp_replace(text, '{_URLS}', ' [链接已移除] ', 'g') AS text, len(regexp_extract_all(text, '{_URLS}'))::INTEGER AS n_urls FROM x",
    "txt8_suffix": "SELECT doc_id, text || chr(10) || chr(10) || 'Give a title.' AS prompt FROM documents",
    "txt9_framed": "SELECT doc_id, CASE lang WHEN 'en' THEN 'Summarise.' WHEN 'de' THEN 'Fasse zusammen.' ELSE 'Summarise the text.' END || chr(10) || chr(10) || '---' || chr(10) || chr(10) || text AS prompt FROM documents",
    "txt10_messages": """SELECT doc_id, '[' || CASE WHEN doc_id % 2 = 0 THEN '{"role":"system","content":"You answer in ' || lang || '"},' ELSE '' END || '{"role":"user","content":' || to_json(text) || '}]' AS messages FROM documents""",
    "txt11_datekey": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '2020-02-29' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_key FROM orders",
    "txt12_timekey": "SELECT event_id, strftime(ts, '%Y-%m-%d %H-%M-%S') AS time_key FROM events",
    "txt14_slug": "SELECT p_partkey, regexp_replace(p_name || ' / ' || p_type, '[^A-Za-z0-9._-]+', '_', 'g') AS slug FROM part",
    "txt15_list": _LISTS + "SELECT id, coalesce(len(items), 0)::INTEGER AS n, coalesce(array_to_string(items, '|'), '') AS items FROM y",
    "txt16_digits": _LISTS + "SELECT id, try_cast(nullif(regexp_replace(port, '[^0-9]', '', 'g'), '') AS BIGINT) AS port, try_cast(nullif(regexp_replace(port, '[^0-9]', '', 'g'), '') AS BIGINT) IS NULL AS failed FROM y",
    "txt17_title": f"WITH x AS ({_twin(TITLES, 'orders')}), y AS (SELECT id, CASE WHEN title <> '' AND n_tags > 0 THEN title ELSE 'AI 日报 ' || {_DATE} END AS title, {_DATE} AS d FROM x) SELECT id, title, '[' || d || ' 摘要] ' || title AS subject FROM y",
    "txt18_status": f"WITH x AS ({_twin(RECORDS, 'documents')}) SELECT doc_id, CASE WHEN record IS NULL THEN 'extract_failed' WHEN text = '' THEN 'empty' ELSE 'ok' END AS status FROM x",
    "txt19_junk": f"WITH x AS ({_JUNK.format(source='(SELECT *, 0 AS quality FROM documents)')}) SELECT doc_id, n_len, symbol_share, repeat_share, {_IS_JUNK} AS junk FROM x",
    "txt19_junk_accuracy": f"WITH x AS ({_JUNK.format(source='documents JOIN labels USING (doc_id)')}) SELECT quality, {_IS_JUNK} AS junk, count(*) AS n FROM x GROUP BY ALL",
    "txt20_limit": "SELECT doc_id, length(text) <= 150 AS within_limit FROM documents",
}
