"""Registered queries of the subpackage, each over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import byte_bpe, collocation, dialog_repair, embedding_dedup, fingerprint, html_consensus, line_dedup, minhash, packing, quality_rules, toxicity, url_graph, warc_fixity
from docloom.llm.common import table
from docloom.llm.sql import ORACLES  # noqa: F401


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain of categories fitted on ``labels``; ``rejected`` marks toxic documents."""
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, toxicity.targets(table(spark, sf_dir, "labels")), toxicity.CATEGORIES)
    return toxicity.score(docs, chain).withColumn("toxic", F.col("rejected")).withColumn("kept", ~F.col("rejected"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every document; a null or empty text has no word and fails."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, decoded bytes and offsets of every document as digests; a null text is empty, with no id.

    ``n_split`` counts ids that begin inside a character, ``spans_crc32`` sums up the first and
    last-plus-one characters of all ids (``byte_bpe.encode``).
    """
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), vocabulary, spans=True)
    done = byte_bpe.decode(encoded, vocabulary, keep=("n_split", "spans_crc32"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"), "n_split", "spans_crc32")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later repeats of line runs; null and empty texts stay as they are."""
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component at two-word shingles and 0.8; a text without words links with nothing."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; a url without ``://`` has neither and is allowed."""
    return url_graph.judge(table(spark, sf_dir, "pages"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and component; one without a label or a direction links with nothing."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 2048 tokens; a null text has its end token only."""
    return packing.pack(table(spark, sf_dir, "documents"), packing.with_end(public_tokenizers.path("byte_bpe_50k.json")))


#: Places of one archive file of the audited replicas.
FILE_PLACES = 4096


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of the archive of all pages: the second has a changed byte in some records and lacks others."""
    pages = table(spark, sf_dir, "pages").withColumn("page_id", F.col("page_id").cast("long"))
    place = F.pmod("page_id", F.lit(FILE_PLACES))
    places = [F.call_function("div", F.col("page_id") - place, F.lit(FILE_PLACES)).alias("file"), place.alias("place")]
    one = pages.select(*places, url_graph_record(F.col("html")).alias("record"))
    damaged = F.when(F.pmod("page_id", F.lit(89)) == 7, F.concat(F.coalesce("html", F.lit("")), F.lit("\x00"))).otherwise(F.col("html"))
    two = pages.where(F.coalesce(F.pmod("page_id", F.lit(211)) != 5, F.lit(True))).select(*places, url_graph_record(damaged).alias("record"))
    found = warc_fixity.audit(one, two, file_places=FILE_PLACES)
    return found.select((F.col("file") * FILE_PLACES + F.col("place")).alias("page_id"), "status", "length_one", "length_two")


def url_graph_record(html):
    return warc_fixity.warc_record(F.col("url"), html)


def op10_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null html gives an empty one."""
    return html_consensus.main_text(table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired: its faults, the cheapest edits and the hash of the repaired text."""
    given = table(spark, sf_dir, "conversations")
    damaged = dialog_repair.damage(given)
    audits = dialog_repair.audit(dialog_repair.repair(damaged))
    # rows of a conversation meet by grouping, which takes a null id for an id
    parts = given.select("conv_id").distinct().unionByName(dialog_repair.gaps(damaged), True).unionByName(audits, True)
    counts = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return parts.groupBy("conv_id").agg(*counts, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of each lang among phrases that occur 100 times."""
    return collocation.collocations(table(spark, sf_dir, "documents"), least=100, best=2000)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how alike they and the next document's are."""
    done = fingerprint.edited(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_line_dedup": op4_line_dedup,
    "op5_minhash": op5_minhash,
    "op6_url_filters": op6_url_filters,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_packing": op8_packing,
    "op9_warc_fixity": op9_warc_fixity,
    "op10_html_consensus": op10_html_consensus,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_collocations": op12_collocations,
    "op13_fingerprints": op13_fingerprints,
    "pipeline": pipeline,
}
