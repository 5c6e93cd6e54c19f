"""Queries over streams run to their end, and over files written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import index
from docloom.plans import logs, pages
from docloom.plans.support import Query, table
from docloom.sources import io, snapshots
from docloom.streaming import streams


def str1_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = streams.table_stream(spark, sf_dir, "orders")
    log = orders.select(text.date_key(F.col("o_orderdate")).alias("d"), F.col("o_orderkey").alias("k"), F.concat(F.lit("E"), F.col("o_orderkey")).alias("entry"))
    return streams.index_stream(log, io.work_path(spark, "index")).select("d", "entry", "first_seen")


def str2_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = streams.table_stream(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.split("text", " ").alias("w"))
    middle = F.floor(F.size("w") / 2)
    rows = turns.select("conv_id", "turn", "w", F.posexplode("w").alias("seq", "text")).select("conv_id", "turn", "seq", "text", F.when((F.col("conv_id") % 10 == 0) & (F.col("seq") == middle), "boom").alias("error"))
    return streams.chunk_stream(rows, io.work_path(spark, "chunks"))


def str3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.page_stream(streams.table_stream(spark, sf_dir, "pages"), io.work_path(spark, "pages"))


def str4_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = streams.table_stream(spark, sf_dir, "events")
    operations = events.select(F.col("user_id").alias("op_id"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("done"))
    return streams.status_stream(operations, io.work_path(spark, "status"))


def src3_texts(spark: SparkSession, sf_dir: str, file_rows: int = 2000) -> DataFrame:
    """Whole texts by source, written as files of about ``file_rows`` texts each, read whole and added up by source."""
    path = io.work_path(spark, "texts")
    docs = table(spark, sf_dir, "documents")
    buckets = docs.count() // file_rows + 1
    # a source of any size falls into buckets by its ids
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket")
    lines = docs.select("source", bucket, F.col("text").alias("value"))
    lines.repartition("source", "bucket").write.partitionBy("source", "bucket").text(path)
    rows = spark.read.schema("text string, source string, bucket long").text(path, wholetext=True)
    counts = rows.select("source", F.size(F.split(F.regexp_replace("text", r"\n$", ""), "\n")).alias("lines"), F.length("text").alias("chars"))
    return counts.groupBy("source").agg(F.sum("lines").cast("long").alias("lines"), F.sum("chars").cast("long").alias("chars")).select("lines", "chars")


def src4_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index files by year, read whole: an indented array, a record a line, or a broken array; dateless and odd records go to quarantine."""
    entries = index.upsert(logs.entry_log(spark, sf_dir), "d", "k", "entry")
    year = F.substring("d", 1, 4)
    rows = entries.select(year.alias("year"), F.struct(F.when(F.substring("d", 9, 2) != "13", F.col("d")).alias("date"), F.concat(F.lit("AI 日报 "), F.col("entry")).alias("title"), F.array(F.lit("标签"), F.col("d")).alias("tags")).alias("e"), "d")
    items = rows.groupBy("year").agg(F.array_sort(F.collect_list(F.struct("d", F.to_json("e").alias("j")))).getField("j").alias("j"))
    indented = F.concat(F.lit("[\n    "), F.array_join(F.transform("j", lambda x: F.replace(F.replace(x, F.lit(","), F.lit(",\n        ")), F.lit("{"), F.lit("{\n        "))), ",\n    "), F.lit("\n]"))
    body = F.when(F.col("year") % 3 == 0, indented).when(F.col("year") % 3 == 1, F.concat(F.array_join("j", "\n"), F.lit("\n7\n{broken\n"))).otherwise(F.concat(F.lit("["), F.array_join("j", ", "), F.lit(", ")))
    path = io.work_path(spark, "index")
    items.select("year", body.alias("value")).repartition("year").write.partitionBy("year").text(path)
    good, bad = io.read_index(spark, path)
    kept = good.select("date", "title", F.array_join("tags", ",").alias("tags"), F.lit(None).cast("string").alias("reason"), F.lit(1).cast("long").alias("n"))
    return kept.unionByName(bad.groupBy("reason").agg(F.count("*").alias("n")), allowMissingColumns=True)


def snk2_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the index, each written whole as JSON; the reader takes the one of the last manifest."""
    entries = index.upsert(logs.entry_log(spark, sf_dir), "d", "k", "entry").select(F.col("d").alias("date"), F.concat(F.lit("AI 日报 "), F.col("entry")).alias("title"), F.array(F.lit("标签")).alias("tags"))
    root = io.work_path(spark, "snapshots")
    snapshots.replace(entries.where("date < '1995-01-01'"), root)
    snapshots.replace(entries, root)
    return snapshots.read(spark, root).select("date", "title", F.array_join("tags", ",").alias("tags"))


def snk1_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly reports; the second write replaces the months of the first half-years only."""
    path = io.work_path(spark, "reports")
    months = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("report_date")).agg(F.count("*").alias("orders"))
    io.write_by_date(months.select(F.lit("first").alias("body"), "orders", "report_date"), path)
    io.write_by_date(months.where("substring(report_date, 6, 2) <= '06'").select(F.lit("second").alias("body"), "orders", "report_date"), path)
    return spark.read.schema("body string, orders long, report_date string").parquet(path)


def snk3_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = io.work_path(spark, "runs")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("summary"))
    io.append_run(docs, path, "2024-01-31 10-00-00")
    io.append_run(docs.where("doc_id % 2 = 0"), path, "2024-02-01 10-00-00")
    return spark.read.schema("doc_id long, summary string, run_ts string").parquet(path)


def snk4_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "pages").select("page_id", "html")
    clean = raw.select("page_id", text.compact(text.body_of(F.col("html"))).alias("body"))
    paths = io.write_stages({"raw": raw, "clean": clean}, io.work_path(spark, "stages"))
    stage = lambda n, c: spark.read.parquet(paths[n]).select(F.lit(n).alias("stage"), F.length(c).alias("chars"))
    return stage("raw", "html").unionByName(stage("clean", "body")).groupBy("stage").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"))


def snk5_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analysis per input, named after it, with its source and time as columns."""
    rows = table(spark, sf_dir, "pages").select(text.base_name(F.regexp_replace("url", r"[?#].*$", "")).alias("input"), "page_id")
    rows = rows.select(text.swap_extension(F.concat("input", F.lit("-"), "page_id", F.lit(".txt")), "_notes.md").alias("name"), F.col("input").alias("source"), F.lit("2024-01-31 10:00").alias("made"))
    path = io.work_path(spark, "notes")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


QUERIES: dict[str, Query] = {f.__name__: f for f in (str1_final, str2_final, str3_pages, str4_status, src3_texts, src4_index, snk2_snapshot, snk1_reports, snk3_append, snk4_stages, snk5_notes)}
ORACLES = {
    "str1_final": logs.ORACLES["agg4_upsert"],
    "str2_final": logs.ORACLES["agg5_assemble"],
    "str3_pages": pages._PREPARED + "SELECT page_id, substring(c, 1, 30000) AS body FROM z",
    "str4_status": "SELECT user_id AS op_id, CASE WHEN arg_max(event_type, (ts, event_id)) = 'purchase' THEN 'done' ELSE 'pending' END AS status FROM events GROUP BY user_id",
    "src3_texts": "SELECT sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(length(text) + 1)::BIGINT AS chars FROM documents GROUP BY source",
    "src4_index": logs._INDEX + """, y AS (SELECT d, entry, substr(d, 1, 4)::INTEGER AS y, substr(d, 9, 2) = '13' AS dateless FROM x)
 SELECT d AS date, 'AI 日报 ' || entry AS title, '标签,' || d AS tags, NULL AS reason, 1::BIGINT AS n FROM y WHERE NOT dateless AND y % 3 < 2
 UNION ALL SELECT NULL, NULL, NULL, 'no date', count(*) FROM y WHERE dateless AND y % 3 < 2 HAVING count(*) > 0
 UNION ALL SELECT NULL, NULL, NULL, 'not an object', count(DISTINCT y) FROM y WHERE y % 3 = 1 HAVING count(*) > 0
 UNION ALL SELECT NULL, NULL, NULL, 'malformed', count(DISTINCT y) FROM y WHERE y % 3 > 0 HAVING count(*) > 0""",
    "snk2_snapshot": logs._INDEX + "SELECT d AS date, 'AI 日报 ' || entry AS title, '标签' AS tags FROM x",
    "snk1_reports": "SELECT CASE WHEN month(o_orderdate) <= 6 THEN 'second' ELSE 'first' END AS body, count(*) AS orders, strftime(o_orderdate, '%Y-%m') AS report_date FROM orders GROUP BY ALL",
    "snk3_append": "SELECT doc_id, text AS summary, '2024-01-31 10-00-00' AS run_ts FROM documents UNION ALL SELECT doc_id, text, '2024-02-01 10-00-00' FROM documents WHERE doc_id % 2 = 0",
    "snk4_stages": pages._BODIES + f"SELECT 'raw' AS stage, count(*) AS pages, sum(length(html))::BIGINT AS chars FROM x UNION ALL SELECT 'clean', count(*), sum(length({pages._COMPACT}))::BIGINT FROM x",
    "snk5_notes": r"SELECT list_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/'), -1) || '-' || page_id || '_notes.md' AS name, list_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/'), -1) AS source, '2024-01-31 10:00' AS made FROM pages",
}
