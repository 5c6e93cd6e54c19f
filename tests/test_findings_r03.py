"""Findings of the third round, each by what would have failed before."""

import duckdb
import pandas as pd
import pytest

from docloom.functions import blocks as md
from docloom.operators import dedupe, retrieve, tracker, vocab
from docloom.plans import logs, retrieval, study
from docloom.sources.io import stored
from docloom.streaming import streams


def test_every_earlier_turn_is_seen_however_long(spark, tmp_path):
    said = "x" * 900
    spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", said) for t in range(5)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r for r in logs.cnv3_context(spark, str(tmp_path)).collect()}
    assert [(got[t].n_before, got[t].chars_before) for t in (0, 2, 4)] == [(0, 0), (2, 1800), (4, 3600)]
    assert got[4].context.count(said) == 4


def test_phrases_are_counted_without_a_shuffle_of_phrases(spark):
    docs = spark.createDataFrame([(1, "b a b a b"), (1, "a b"), (2, None), (3, "one"), (None, "x y x y")], "doc_id long, text string")
    found = vocab.phrases(docs, k=2)
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "a b", 3, 1), (1, "b a", 2, 2), (None, "x y", 2, 1), (None, "y x", 1, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "phrase#" not in plan.split("Aggregate")[1]


NOTES = "# N\n## 1. Session Overview\n- **Learner**: 7\n- **Date**: 2025-01-02\n- **Chapter**: Chapter 3\n## Gaps Identified\n| Topic | Chapter |\n|---|---|\n| a \\| b | |\n"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_parsed_without_shuffle_or_sort(spark):
    docs = spark.createDataFrame([(1, NOTES), (None, "- a\n    - b: c"), (None, "| x |\n| y |")], "doc_id long, text string")
    rows = md.blocks(docs, ["doc_id"])
    assert not any(w in plan_of(rows) for w in ("Exchange", "Sort", "Window"))
    assert [(r.kind, r.parent) for r in rows.where("doc_id IS NULL").collect()] == [("item", None), ("item", 0), ("row", None)]  # documents without a key stay apart
    for found in (vocab.records(rows), vocab.phrase_records(rows)):
        assert not any(w in plan_of(found) for w in ("Exchange", "Sort", "Join", "Union"))


def test_notes_trackers_and_entities_of_lists_need_no_shuffle(spark):
    docs = spark.createDataFrame([(1, NOTES)], "session_id long, text string")
    listed, rows = md.listed(docs, ["session_id"]), md.blocks(docs, ["session_id"])
    for made in (tracker.session_findings, tracker.session_heads, tracker.session_topics, lambda r: tracker.typed_rows(r, "session_id"), lambda r: vocab.entities(r, "session_id")):
        assert not any(w in plan_of(made(listed)) for w in ("Exchange", "Sort", "Window", "Join"))
        assert made(listed).collect() == made(rows).collect()
    assert [tuple(r) for r in tracker.session_findings(listed).collect()] == [(1, 7, "2025-01-02", "gap", "a | b", 3, None, None)]


def test_lines_are_read_as_the_patterns_of_spark_mean_them(spark):
    text = "a: b\u2028c\r\nk : v\r\n**b** /i/ (x) y\n\u3000# H\u3000\n\t- [X] z: http://q\n|a\\|b||\n|c|"
    got = [(r.kind, r.label, r.value, r.ipa, r.aside) for r in md.blocks(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).collect()]
    assert got == [("text", None, None, None, None), ("text", "k", "v", None, None), ("text", "b", "y", "i", "x"), ("heading", None, None, None, None), ("item", "z", "http://q", None, None), ("row", None, None, None, None)]


def test_a_tables_one_split_is_spread_over_all_cores(spark, sf_dir):
    assert study.session_corpus(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_the_check_of_trackers_gathers_no_blocks(spark, sf_dir):
    plan = study.trk5_check(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan


def test_a_task_gives_back_k_hits_a_query(spark):
    docs = spark.createDataFrame([(i, "a b " * (i % 7 + 1) + "c") for i in range(500)], "doc_id long, text string").repartition(3)
    found = retrieve.bm25(docs, spark.createDataFrame([(1, "a c"), (2, "B"), (3, "none")], "item_id long, text string"), k=2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and plan.count("MapInArrow") == 1
    assert [(r.item_id, r.doc_id, r["rank"]) for r in found.orderBy("item_id", "rank").collect()] == [(1, 1, 1), (1, 8, 2), (2, 6, 1), (2, 13, 2)]


@pytest.mark.parametrize("round_terms", [1_000_000, 2])
def test_odd_documents_and_rounds_are_scored_as_the_twin_scores_them(spark, tmp_path, monkeypatch, round_terms):
    monkeypatch.setattr(retrieve, "ROUND_TERMS", round_terms)
    monkeypatch.setattr(retrieve, "SUMS", 3)
    texts = [(1, "Ab, cd ab"), (1, "cd"), (2, None), (3, ""), (None, "ab ef"), (None, "ab"), (4, " ef ÄB "), (5, "ab cd ef gh"), (6, "gh gh ab"), (7, "ab cd ef gh"), (8, "zz"), (2, "ab")]
    spark.createDataFrame([(i, t, "s") for i, t in texts], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "ab cd"), (1, "ab ef"), (2, "äb gh"), (3, None), (4, "none"), (None, "EF, ef")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    told = con.execute(retrieval.ORACLES["rag2_lexical"]).fetchall()
    found = retrieval.rag2_lexical(spark, str(tmp_path)).select("item_id", "doc_id", "score", "rank").collect()
    assert sorted(map(tuple, found), key=str) == sorted(told, key=str) and len(told) > 6


def test_no_hits_without_queries_or_documents(spark):
    docs, none = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([("q", "a")], "item_id string, text string")
    assert retrieve.bm25(docs, asked.where("false")).collect() == [] == retrieve.bm25(none, asked).collect()
    assert [(r.item_id, r.doc_id) for r in retrieve.bm25(docs, asked).collect()] == [("q", 1)]


def test_texts_of_all_documents_are_not_shuffled_for_a_few_hits(spark, sf_dir):
    for query in (retrieval.rag5_grounded, retrieval.rag6_citations, retrieval.rag7_summary):
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [doc_id" not in plan and "BroadcastHashJoin [doc_id" in plan


def test_only_shared_shingles_are_stored_and_each_part_is_bounded(spark, monkeypatch):
    texts = [(i, f"one two three four five w{i} " + " ".join(f"x{i}y{j}".replace("0", "a").translate(str.maketrans("123456789", "bcdefghij")) for j in range(50))) for i in range(40)]
    texts += [(100, "One, two three four five!"), (101, "one two THREE four five"), (102, "..."), (103, "..."), (104, None), (None, "one two three four five"), (100, "..."), (105, "two words"), (106, "Two words")]
    kept = {}
    monkeypatch.setattr(dedupe, "stored", lambda df, name: kept.setdefault(name, stored(df, name)) if name == "near-common" else stored(df, name))
    found = dedupe.near_items(spark.createDataFrame(texts, "doc_id long, text string"))
    got = sorted(((r.id, r.n_shingles, r.class_id, r.members) for r in found.where("id IS NULL OR id >= 100").collect()), key=str)
    assert got == sorted([(100, 3, 100, 3), (100, 0, 100, 3), (101, 3, 100, 3), (102, 0, 102, 1), (103, 0, 103, 1), (104, 0, 104, 1), (None, 3, None, 1), (105, 1, 105, 2), (106, 1, 105, 2)], key=str)
    # 54 shingles each, of which the four of "one two three four five w" are shared
    assert {(r.n, len(r.t)) for r in kept["near-common"].where("n > 9").collect()} == {(54, 4)}


def test_frequent_words_are_ranked_where_they_are_counted(spark, monkeypatch):
    texts = [(i % 30, f"Common words are here. Some are r{'abcdefgh'[i % 8]}re{'xyz'[i % 3]} or common again.") for i in range(60)] + [(None, "Nobody knows nobody"), (31, None), (32, "a b")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    every = vocab.key_words(docs, k=4).orderBy("doc_id", "rank").collect()
    told = {(r.doc_id, r.word): r.context for r in vocab.vocabulary(docs.where("doc_id IS NULL OR doc_id > 30").fillna(40, ["doc_id"]), k=2).collect()}
    assert told == {(40, "nobody"): "Nobody knows nobody", (40, "knows"): "Nobody knows nobody"}
    kept = {}
    monkeypatch.setattr(vocab, "OFTEN", 3)
    monkeypatch.setattr(vocab, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    assert vocab.key_words(docs, k=4).orderBy("doc_id", "rank").collect() == every and len(every) == 30 * 4 + 2
    assert kept["frequent-words"].count() == 3 and kept["key-words"].where("score IS NOT NULL").groupBy("doc_id").count().where("count > 4").isEmpty()


def test_a_batch_of_chunks_costs_three_round_trips_of_state():
    calls = []

    class State:
        def __init__(self, name):
            self.name, self.held = name, []

        def __getattr__(self, call):
            def called(*values):
                calls.append(f"{self.name}.{call}")
                if self.name == "head":
                    if call == "update":
                        self.held = [values[0]]
                    return self.held[0] if self.held else None
                self.held += values
                return iter(self.held)

            return called

    work = streams.Assembly()
    work.head, work.early, work.pieces = State("head"), State("early"), State("pieces")
    frame = pd.DataFrame({"seq": range(300), "text": ["a"] * 300, "error": [None] * 300})
    first = next(iter(work.handleInputRows((1, 2), iter([frame]), None)))
    assert calls == ["head.get", "pieces.appendValue", "head.update"] and first.iloc[0].tolist() == [1, 2, "a" * 300, False, 300, False]
    late = pd.DataFrame({"seq": [301, 300, 5], "text": ["c", "b", "no"], "error": [None, None, "no"]})
    work.early.containsKey, work.early.getValue = lambda k: bool(work.early.held) and k == (301,), lambda k: ("c", None)
    again = next(iter(work.handleInputRows((1, 2), iter([late]), None)))
    assert again.iloc[0].tolist() == [1, 2, "a" * 300 + "bc", False, 302, False]
