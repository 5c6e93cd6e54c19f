"""Queries over logs, chunks, conversations, lookups and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import chunks, convo, index, lookups
from docloom.operators.report import top_k
from docloom.plans.support import Query, table

ENTRIES = "SELECT strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderkey AS k FROM orders"
#: Assistant turns fall into words; every tenth conversation fails at the middle of each answer.
CHUNKS = """SELECT conv_id, turn, i AS seq, w[i + 1] AS text, CASE WHEN conv_id % 10 = 0 AND i = len(w) // 2 THEN 'boom' END AS error
 FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations WHERE role = 'assistant'), unnest(range(len(w))) AS u(i)"""
TURNS = "SELECT conv_id, turn, role, CASE WHEN role = 'user' AND turn >= 3 AND conv_id % 3 = 0 THEN ' EXIT ' WHEN role = 'user' AND turn = 1 AND conv_id % 5 = 1 THEN '   ' ELSE text END AS text FROM conversations"


def entry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(text.date_key(F.col("o_orderdate")).alias("d"), F.col("o_orderkey").alias("k"), F.concat(F.lit("E"), F.col("o_orderkey")).alias("entry"))


def chunk_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.split("text", " ").alias("w"))
    middle = F.floor(F.size("w") / 2)
    return rows.select("conv_id", "turn", "w", F.posexplode("w").alias("seq", "text")).select("conv_id", "turn", "seq", "text", F.when((F.col("conv_id") % 10 == 0) & (F.col("seq") == middle), "boom").alias("error"))


def turn_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("role") == "user"
    said = F.when(user & (F.col("turn") >= 3) & (F.col("conv_id") % 3 == 0), " EXIT ").when(user & (F.col("turn") == 1) & (F.col("conv_id") % 5 == 1), "   ").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", said.alias("text"))


def agg4_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.upsert(entry_log(spark, sf_dir), "d", "k", "entry").select("d", "entry", "first_seen")


def jon1_snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older half of the log as a snapshot, the rest merged into it: equal to one upsert."""
    log = entry_log(spark, sf_dir)
    halves = [index.upsert(log.where(F.col("k") % 2 == i), "d", "k", "entry") for i in (0, 1)]
    snapshot, delta = halves
    merged = index.merge(snapshot, delta, "d", "entry")
    return merged.select("d", "entry", "first_seen", "last_seen")


def win4_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.positions(index.upsert(entry_log(spark, sf_dir), "d", "k", "entry")).select("d", "position")


def agg5_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.assemble(chunk_log(spark, sf_dir), ["conv_id", "turn"])


def agg5_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.assemble(chunk_log(spark, sf_dir), ["conv_id", "turn"], policy="drop")


def src8_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_log(spark, sf_dir).groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.count("error").alias("errors"))


def cnv1_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convo.until_stop(turn_log(spark, sf_dir))


def cnv2_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convo.drop_blank(convo.until_stop(turn_log(spark, sf_dir)))


def cnv3_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All earlier turns that each user turn sees."""
    return convo.context(table(spark, sf_dir, "conversations"), budget=None)


def cnv4_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    failing = (F.col("role") == "assistant") & (F.col("conv_id") % 7 == 2) & (F.col("turn") >= 2)
    return convo.with_status(turn_log(spark, sf_dir), failing).select("conv_id", "turn", "status")


def cnv5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convo.pairs(table(spark, sf_dir, "conversations"))


def jon2_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    providers = spark.createDataFrame([("EN", "hosted", "m-1", True), ("de", "local", "m-2", True), ("fr", "hosted", "m-3", False)], "name string, type string, model_id string, has_key boolean")
    return lookups.resolve_provider(table(spark, sf_dir, "documents").select("doc_id", "lang"), providers, "lang").select("doc_id", "type", "model_id", "status")


def jon3_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame([("news", "Report on: "), ("notes", "Note: ")], "name string, body string")
    rows = lookups.with_template(table(spark, sf_dir, "documents"), templates, "news", "Summarise: ")
    return rows.select("doc_id", F.concat("body", "text").alias("prompt"))


def jon4_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    outputs = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "ok").otherwise("failed").alias("status"))
    return lookups.retry_set(docs, outputs, "doc_id")


def jon5_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), "text")
    temp = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 2).cast("string").alias("name"), "text")
    paths = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("name"), F.concat(F.lit("label "), F.col("quality")).alias("text"))
    return lookups.replacement(docs, temp, paths, "name")


def jon6_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame([("small", 1, 10), ("middle", 11, 30), ("large", 31, 45)], "band string, lo int, hi int")
    return lookups.in_range(table(spark, sf_dir, "part").select("p_partkey", "p_size"), ranges, F.col("p_size")).select("p_partkey", "band")


def win1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 5)


def win2_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text"), F.min("turn").alias("first_turn"))


def win3_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.tail(F.col("text"), "\n").alias("last_line"))


def win5_enumerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"\. ")).alias("p", "sentence")).select("item_id", (F.col("p") + 1).alias("number"), "sentence")


def win6_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[F.left("text", F.lit(n)).alias(f"preview_{n}") for n in (500, 200, 100)])


def set1_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("summary"))
    return lookups.union_by_provider(("hosted", docs.where("lang <> 'de'")), ("local", docs.where("lang <> 'fr'")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (agg4_upsert, jon1_snapshot_delta, win4_order, agg5_assemble, agg5_drop, src8_chunks, cnv1_stop, cnv2_blank, cnv3_context, cnv4_errors, cnv5_pairs, jon2_provider, jon3_template, jon4_retry, jon5_replacement, jon6_range, win1_topk, win2_first, win3_last, win5_enumerate, win6_preview, set1_union)
}
_INDEX = f"WITH e AS ({ENTRIES}), x AS (SELECT d, 'E' || max(k) AS entry, min(k) AS first_seen, max(k) AS last_seen FROM e GROUP BY d) "
_CHUNKS = f"WITH c AS ({CHUNKS}), s AS (SELECT conv_id, turn, min(CASE WHEN error IS NOT NULL THEN seq END) AS stop FROM c GROUP BY ALL), g AS (SELECT c.conv_id, c.turn, s.stop IS NOT NULL AS failed, coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE text <> '' AND (stop IS NULL OR seq < stop)), '') AS t, count(*) FILTER (WHERE text <> '' AND (stop IS NULL OR seq < stop)) AS n_chunks FROM c JOIN s ON c.conv_id = s.conv_id AND c.turn = s.turn GROUP BY ALL) "
_ENDED = f"WITH t AS ({TURNS}), x AS (SELECT *, max(CASE WHEN role = 'user' AND lower(trim(text)) IN ('退出', 'exit', 'stop') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM t) "
_BEFORE = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
ORACLES = {
    "agg4_upsert": _INDEX + "SELECT d, entry, first_seen FROM x",
    "jon1_snapshot_delta": _INDEX + "SELECT d, entry, first_seen, last_seen FROM x",
    "win4_order": _INDEX + "SELECT d, row_number() OVER (ORDER BY first_seen DESC) AS position FROM x",
    "agg5_assemble": _CHUNKS + "SELECT conv_id, turn, CASE WHEN failed AND t = '' THEN 'request failed: boom' ELSE t END AS text, failed, n_chunks FROM g",
    "agg5_drop": _CHUNKS + "SELECT conv_id, turn, CASE WHEN NOT failed THEN t END AS text, failed, n_chunks FROM g",
    "src8_chunks": f"WITH c AS ({CHUNKS}) SELECT conv_id, turn, count(*) AS n, count(error) AS errors FROM c GROUP BY ALL",
    "cnv1_stop": _ENDED + "SELECT conv_id, turn, role, text FROM x WHERE e = 0",
    "cnv2_blank": _ENDED + "SELECT conv_id, turn, role, text FROM x WHERE e = 0 AND trim(text) <> ''",
    "cnv3_context": f"WITH x AS (SELECT conv_id, turn, role, count(*) {_BEFORE} AS n_before, coalesce(sum(length(text)) {_BEFORE}, 0)::BIGINT AS chars_before, coalesce(string_agg(role || ': ' || text, chr(10)) {_BEFORE}, '') AS context FROM conversations) SELECT conv_id, turn, n_before, chars_before, context FROM x WHERE role = 'user'",
    "cnv4_errors": f"WITH t AS ({TURNS}), x AS (SELECT *, role = 'assistant' AND conv_id % 7 = 2 AND turn >= 2 AS bad FROM t), y AS (SELECT *, coalesce(max(bad::INTEGER) {_BEFORE}, 0) AS e FROM x) SELECT conv_id, turn, CASE WHEN bad THEN 'error' ELSE 'ok' END AS status FROM y WHERE e = 0",
    "cnv5_pairs": "WITH x AS (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, question, answer FROM x WHERE role = 'user' AND nr = 'assistant'",
    "jon2_provider": "SELECT doc_id, CASE lang WHEN 'en' THEN 'hosted' WHEN 'de' THEN 'local' WHEN 'fr' THEN 'hosted' END AS type, CASE lang WHEN 'en' THEN 'm-1' WHEN 'de' THEN 'm-2' WHEN 'fr' THEN 'm-3' END AS model_id, CASE lang WHEN 'en' THEN 'ok' WHEN 'de' THEN 'ok' WHEN 'fr' THEN 'config_missing' ELSE 'unknown' END AS status FROM documents",
    "jon3_template": "SELECT doc_id, 'Report on: ' || text AS prompt FROM documents",
    "jon4_retry": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "jon5_replacement": "SELECT d.doc_id::VARCHAR AS name, coalesce(b.text, 'label ' || l.quality, d.text) AS text, CASE WHEN b.item_id IS NOT NULL THEN 'temp' WHEN l.doc_id IS NOT NULL THEN 'path' ELSE 'original' END AS origin FROM documents d LEFT JOIN benchmark b ON b.item_id * 2 = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "jon6_range": "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size BETWEEN 11 AND 30 THEN 'middle' WHEN p_size BETWEEN 31 AND 45 THEN 'large' END AS band FROM part",
    "win1_topk": "SELECT source, doc_id, n_chars, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 5",
    "win2_first": "SELECT conv_id, arg_min(text, turn) AS first_text, min(turn) AS first_turn FROM conversations GROUP BY conv_id",
    "win3_last": "SELECT doc_id, list_extract(string_split(trim(text), chr(10)), -1) AS last_line FROM documents",
    "win5_enumerate": "SELECT item_id, i::INTEGER AS number, s[i] AS sentence FROM (SELECT item_id, string_split(text, '. ') AS s FROM benchmark), unnest(range(1, len(s) + 1)) AS u(i)",
    "win6_preview": "SELECT doc_id, left(text, 500) AS preview_500, left(text, 200) AS preview_200, left(text, 100) AS preview_100 FROM documents",
    "set1_union": "SELECT doc_id, lang, text AS summary, 'hosted' AS provider FROM documents WHERE lang <> 'de' UNION ALL SELECT doc_id, lang, text, 'local' FROM documents WHERE lang <> 'fr'",
}
