"""Empty, absent and corrupt inputs, nulls, ties and clashing names outside the training-data subpackage."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import chunks, convo, dedupe, graph, index, lookups, retrieve
from docloom.sources import io
from docloom.streaming import streams


def test_index_reader_takes_absent_empty_and_corrupt_files(spark, tmp_path):
    good, bad = io.read_index(spark, str(tmp_path / "absent"))
    assert good.count() == bad.count() == 0 and good.columns == ["date", "title", "tags"]
    (tmp_path / "empty.json").write_text("")
    assert [x.count() for x in io.read_index(spark, str(tmp_path / "empty.json"))] == [0, 0]
    (tmp_path / "mixed.json").write_text('{"date":"2024-01-01","title":"t","tags":["a"]}\n{"date": broken\n{"title":"no date"}\n')
    good, bad = io.read_index(spark, str(tmp_path / "mixed.json"))
    assert [r.date for r in good.collect()] == ["2024-01-01"] and {tuple(r) for r in bad.collect()} == {('{"date": broken', "malformed"), ('{"title":"no date"}', "no date")}
    assert io.read_texts(spark, str(tmp_path / "absent")).count() == 0


def test_fetch_status(spark):
    rows = spark.createDataFrame([(1, 200), (2, 299), (3, 300), (4, None), (5, 199)], "page_id long, status int")
    assert {r.page_id: r.failure for r in io.fetched(rows).collect()} == {1: None, 2: None, 3: "HTTP 300", 4: "no response", 5: "HTTP 199"}


def test_streams_without_data_and_started_again(spark, tmp_path):
    source = tmp_path / "log"
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "d string, k long, entry string")
    rows.limit(0).write.parquet(str(source))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(source))
    out = str(tmp_path / "out")
    assert streams.index_stream(stream(), out).count() == 0
    rows.write.mode("append").parquet(str(source))
    want = [("a", "z", 1), ("b", "y", 2)]
    for _ in range(2):  # the second run has nothing new
        assert sorted((r.d, r.entry, r.first_seen) for r in streams.index_stream(stream(), out).collect()) == want
    parts = spark.createDataFrame([], "conv_id long, turn long, seq long, text string, error string")
    parts.write.parquet(str(tmp_path / "parts"))
    assert streams.chunk_stream(spark.readStream.schema(parts.schema).parquet(str(tmp_path / "parts")), str(tmp_path / "c")).count() == 0
    operations = spark.createDataFrame([], "op_id long, ts timestamp, seq long, done boolean")
    operations.write.parquet(str(tmp_path / "ops"))
    assert streams.status_stream(spark.readStream.schema(operations.schema).parquet(str(tmp_path / "ops")), str(tmp_path / "s")).count() == 0


def test_vector_search_skips_vectors_without_a_direction(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "ROUND_QUERIES", 3)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(60, None), (61, [0.0] * 8), (62, [float("nan")] * 8), (63, [None] * 8), (64, [1.0] * 3), (None, [1.0] * 8), (65, rng.normal(size=8).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(7))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in retrieve.vector_top_k(df, df.where("vec_id % 6 = 0"), k=4).collect())
    x = {i: np.array(v) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    want = []
    for q in (i for i in x if i % 6 == 0):
        scored = sorted((-round(float(x[q] @ x[i] / np.sqrt((x[q] @ x[q]) * (x[i] @ x[i]))), 6), i) for i in x if i != q)[:4]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and [g[3] for g in got] == pytest.approx([w[3] for w in sorted(want)])
    assert retrieve.vector_top_k(df.limit(0), df).count() == 0 and retrieve.vector_top_k(df, df.limit(0)).count() == 0


def test_lexical_search_edges(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red dog red"), (3, None), (4, ""), (5, "red fox")], "doc_id long, text string").withColumn("dl", F.lit("clash"))
    queries = spark.createDataFrame([(1, "Red"), (2, None), (3, "cat"), (4, "fox fox")], "item_id long, text string")
    got = [(r.item_id, r.rank, r.doc_id) for r in retrieve.bm25(docs, queries, k=2).orderBy("item_id", "rank").collect()]
    assert got == [(1, 1, 2), (1, 2, 1), (4, 1, 1), (4, 2, 5)]  # ties go to the smaller id
    assert retrieve.bm25(docs.limit(0), queries).count() == 0 and retrieve.bm25(docs, queries.limit(0)).count() == 0


def test_near_items_edges(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "x y z"), (3, "X, Y; z"), (9, None), (8, "")], "doc_id long, text string").withColumns({"source": F.lit("s"), "node": F.lit("clash"), "key": F.lit("clash")})
    got = sorted(((r.id, r.n_shingles, r.class_id, r.members, r.head) for r in dedupe.near_items(rows).collect()), key=str)
    assert got == sorted([(None, 2, None, 1, True), (5, 2, 5, 1, True), (5, 1, 3, 2, False), (3, 1, 3, 2, True), (9, 0, 9, 1, True), (8, 0, 8, 1, True)], key=str)
    assert dedupe.near_items(rows.limit(0)).count() == 0 and dedupe.merge_near(rows.limit(0)).count() == 0
    merged = {r.class_id: (r.merged, r.links) for r in dedupe.merge_near(spark.createDataFrame([(1, "a b c d", "p"), (2, "a b c d", "q"), (3, "a b c d", "p"), (4, "e f g", None)], "doc_id long, text string, source string")).collect()}
    assert merged == {1: (3, "p|q"), 4: (1, "")}


def test_groups_of_paths(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100), (7, None), (50, 60), (60, 50)]
    got = {r.node: r.group for r in graph.groups(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 60: 50}
    assert graph.groups(spark.createDataFrame([], "a long, b long")).count() == 0


def test_small_tables_by_their_size(spark, monkeypatch):
    wide = spark.createDataFrame([("x" * 100,)] * 5, "t string")
    assert "broadcast" in lookups.small(wide)._jdf.queryExecution().logical().toString().lower()
    monkeypatch.setattr(lookups, "LOOKUP_CHARS", 50)
    assert lookups.small(wide) is wide and lookups.small(wide.limit(0)) is not None


def test_logs_and_turns_edges(spark):
    log = spark.createDataFrame([("a", 1, None), ("a", 1, "x"), (None, 2, "y")], "d string, k long, entry string").withColumn("position", F.lit(0))
    assert {r.d: r.first_seen for r in index.upsert(log, "d", "k", "entry").collect()} == {"a": 1, None: 2}
    assert index.upsert(log.limit(0), "d", "k", "entry").count() == 0
    parts = spark.createDataFrame([(1, 0, "a", None), (1, 1, None, None), (1, 2, "b", "bad"), (2, 0, None, "bad"), (3, 5, "", None)], "r long, seq long, text string, error string")
    assert {r.r: (r.text, r.failed) for r in chunks.assemble(parts, ["r"]).collect()} == {1: ("a", True), 2: ("request failed: bad", True), 3: ("", False)}
    turns = spark.createDataFrame([(1, 1, "user", None), (1, 2, "assistant", "x"), (2, 1, "user", " EXIT "), (2, 2, "assistant", "y")], "conv_id long, turn long, role string, text string").withColumn("_ended", F.lit(1))
    assert sorted(r.conv_id for r in convo.until_stop(turns.drop("_ended")).collect()) == [1, 1]
    assert convo.context(turns.limit(0)).count() == 0


def test_nothing_outside_imports_the_subpackage():
    root = Path(__file__).resolve().parents[1] / "docloom"
    assert [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "docloom.llm" in p.read_text()] == []
