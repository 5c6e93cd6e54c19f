"""Queries of retrieval and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import dedupe, retrieve
from docloom.operators.lookups import small
from docloom.plans.support import Query, spread, table
from docloom.sources.io import stored

STORES = ["src0", "src3", "src7"]


def src5_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.lit("/kb"), "source", F.concat("doc_id", F.lit(".txt")))
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.split(path, "/"), -1).alias("display_name"), F.length("text").alias("chars"))


def rag1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.chunk(table(spark, sf_dir, "documents"), "doc_id", "text")


def rag1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = retrieve.terms(table(spark, sf_dir, "documents"), "doc_id", "text")
    return index.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("uses"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.bm25(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), table(spark, sf_dir, "benchmark"))


def rag2_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir)


def rag3_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 100, against all."""
    vectors = table(spark, sf_dir, "embeddings")
    return retrieve.vector_top_k(vectors, vectors.where("vec_id % 100 = 0"))


def rag4_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = retrieve.in_stores(table(spark, sf_dir, "documents"), STORES)
    return retrieve.bm25(spread(docs.select("doc_id", "text"), "doc_id"), table(spark, sf_dir, "benchmark"))


def rag5_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.grounded_prompt(table(spark, sf_dir, "benchmark"), _hits(spark, sf_dir), table(spark, sf_dir, "documents"))


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as chunk lists with gaps: text null for odd documents, content null for ids divisible by 3."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("t"))
    c = F.struct(F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("title"), F.when(F.col("doc_id") % 2 == 0, F.col("t")).alias("text"), F.when(F.col("doc_id") % 3 != 0, F.col("t")).alias("content"), F.concat(F.lit("kb/"), "doc_id").alias("uri"))
    # the few hits go to the documents, whose texts stay where they lie
    lists = small(stored(_hits(spark, sf_dir), "hits")).join(docs, "doc_id").groupBy("item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", c.alias("c")))), lambda x: x["c"]).alias("chunks"))
    empty = F.filter("chunks", lambda _: F.lit(False))
    return lists.select("item_id", F.when(F.col("item_id") % 8 == 7, None).when(F.col("item_id") % 8 == 6, empty).otherwise(F.col("chunks")).alias("chunks"))


def rag6_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.citations(_cited(spark, sf_dir))


def rag7_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.citation_summary(_cited(spark, sf_dir))


def agg6_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.merge_equal(table(spark, sf_dir, "documents"))


def agg7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates."""
    return dedupe.near_items(table(spark, sf_dir, "documents"))


def agg7_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each class of near duplicates as one item with all its sources."""
    return dedupe.merge_near(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (src5_ingest, rag1_chunks, rag1_terms, rag2_lexical, rag3_vector, rag4_scoped, rag5_grounded, rag6_citations, rag7_summary, agg6_merge, agg7_near, agg7_merge)}
_SPLIT = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: w <> '')"


def _bm25(source: str) -> str:
    return f"""WITH d AS (SELECT doc_id, {_SPLIT} AS ws FROM {source}), t AS (SELECT doc_id, w AS term, count(*) AS tf FROM d, unnest(ws) AS u(w) GROUP BY ALL),
 l AS (SELECT doc_id, len(ws) AS dl FROM d), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), q AS (SELECT DISTINCT item_id, w AS term FROM (SELECT item_id, {_SPLIT} AS ws FROM benchmark), unnest(ws) AS u(w)),
 f AS (SELECT term, count(*) AS df FROM t WHERE term IN (SELECT term FROM q) GROUP BY term),
 h AS (SELECT item_id, t.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN t ON q.term = t.term JOIN f ON f.term = t.term JOIN l ON l.doc_id = t.doc_id, s GROUP BY ALL),
 hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM h) WHERE rank <= 3) """


# shingles of three words (fewer words are one), pairs by the whole sets, and the smallest id that links reach
_NEAR = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, {_SPLIT} AS ws FROM documents),
 s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS x FROM d, unnest(range(1, greatest(len(ws) - 1, least(len(ws), 1) + 1))) AS u(i)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
 l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 50 * (x.n + y.n - shared)),
 r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
 c AS (SELECT r.a AS doc_id, min(r.b) AS class_id FROM r GROUP BY r.a), m AS (SELECT class_id, count(*) AS members FROM c GROUP BY class_id) """
_CITED = _bm25("documents") + ", c AS (SELECT item_id, rank, CASE WHEN doc_id % 5 <> 0 THEN source END AS title, CASE WHEN doc_id % 2 = 0 THEN text END AS text, CASE WHEN doc_id % 3 <> 0 THEN text END AS content, 'kb/' || doc_id AS uri FROM hits JOIN documents USING (doc_id)) "
_DOT = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[])"
ORACLES = {
    "src5_ingest": "SELECT doc_id, doc_id || '.txt' AS display_name, length(text)::INTEGER AS chars FROM documents",
    "rag1_chunks": "SELECT doc_id, i::INTEGER AS chunk, substring(text, i * 300 + 1, 400) AS chunk_text FROM documents, unnest(range((greatest(length(text) - 100, 1) - 1) // 300 + 1)) AS u(i) WHERE length(text) > 0",
    "rag1_terms": f"WITH x AS (SELECT doc_id, {_SPLIT} AS ws FROM documents), t AS (SELECT doc_id, w AS term, count(*) AS tf FROM x, unnest(ws) AS u(w) GROUP BY ALL) SELECT term, count(*) AS docs, sum(tf)::BIGINT AS uses FROM t GROUP BY term",
    "rag2_lexical": _bm25("documents") + "SELECT item_id, doc_id, score, rank FROM hits",
    "rag3_vector": f"WITH s AS (SELECT q.vec_id AS query_id, d.vec_id, round({_DOT.format('q.embedding', 'd.embedding')} / sqrt({_DOT.format('q.embedding', 'q.embedding')} * {_DOT.format('d.embedding', 'd.embedding')}), 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id) SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 3",
    "rag4_scoped": _bm25("documents WHERE source IN ('src0', 'src3', 'src7')") + "SELECT item_id, doc_id, score, rank FROM hits",
    "rag5_grounded": _bm25("documents") + ", p AS (SELECT item_id, string_agg('[' || rank || '] ' || left(text, 200), chr(10) ORDER BY rank) AS p FROM hits JOIN documents USING (doc_id) GROUP BY item_id) SELECT b.item_id, 'Answer only from the passages below. If they do not hold the answer, say so.' || chr(10) || chr(10) || coalesce(p, '') || chr(10) || chr(10) || b.text AS prompt, p IS NULL AS no_grounding FROM benchmark b LEFT JOIN p ON p.item_id = b.item_id",
    "rag6_citations": _CITED + "SELECT item_id, rank AS number, coalesce(title, 'N/A') AS title, coalesce(text, content, 'no text') AS text, uri FROM c WHERE item_id % 8 < 6 UNION ALL SELECT DISTINCT item_id, NULL, NULL, NULL, NULL FROM c WHERE item_id % 8 >= 6",
    "rag7_summary": _CITED + "SELECT item_id, CASE item_id % 8 WHEN 7 THEN 'no_metadata' WHEN 6 THEN 'no_chunks' ELSE 'ok' END AS status, CASE WHEN item_id % 8 < 6 THEN coalesce(arg_min(coalesce(title, 'N/A'), rank)) END AS first_title, CASE WHEN item_id % 8 < 6 THEN count(*) ELSE 0 END AS n_chunks FROM c GROUP BY item_id",
    "agg7_near": _NEAR + "SELECT c.doc_id AS id, coalesce(n.n, 0) AS n_shingles, class_id, members, members > 1 AS linked, c.doc_id = class_id AS head FROM c JOIN m USING (class_id) LEFT JOIN n ON n.doc_id = c.doc_id",
    "agg7_merge": _NEAR + "SELECT class_id, count(*) AS merged, array_to_string(list_sort(list_distinct(list(source))), '|') AS links FROM c JOIN d USING (doc_id) GROUP BY class_id",
    "agg6_merge": "SELECT sha256(text) AS item_key, min(doc_id) AS first_id, count(*) AS merged, array_to_string(list_sort(list_distinct(list(source))), '|') AS links FROM documents GROUP BY text",
}
