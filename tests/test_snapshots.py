"""Versioned tables, index files of every shape, and streams that keep their state in them."""

import json
import time

import pytest
from pyspark.sql import functions as F

from docloom.operators import index
from docloom.sources import io, snapshots
from docloom.streaming import streams


def files(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("*.parquet")}


def test_index_files_of_every_shape(spark, tmp_path):
    entry = lambda d: {"date": d, "title": f"标题 {d}", "tags": ["甲", "b"]}
    shapes = {
        "indented.json": json.dumps([entry("2024-01-01"), entry("2024-01-02"), {"title": "none"}, 7, {"date": ""}], ensure_ascii=False, indent=4),
        "line.json": "﻿" + json.dumps([entry("2024-01-03")]), "lines.json": json.dumps(entry("2024-01-04")) + "\n\n{broken\n" + json.dumps(entry("2024-01-05")) + "\r\n[1]\n",
        "one.json": json.dumps(entry("2024-01-06"), indent=2), "cut.json": json.dumps([entry("2024-01-07")], indent=4)[:-9], "empty.json": " \n", "list.json": "[]",
    }
    for name, text in shapes.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    good, bad = io.read_index(spark, str(tmp_path))
    assert sorted(r.date for r in good.collect()) == [f"2024-01-0{i}" for i in range(1, 7)]
    assert {r.title for r in good.collect()} == {f"标题 2024-01-0{i}" for i in range(1, 7)} and all(r.tags == ["甲", "b"] for r in good.collect())
    assert sorted(r.reason for r in bad.collect()) == ["malformed", "malformed", "no date", "no date", "not an object", "not an object"]


def test_a_version_is_seen_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "t")
    assert snapshots.read(spark, root) is None
    row = lambda n: spark.createDataFrame([(n, f"标 {n}")], "n long, t string")
    snapshots.replace(row(0), root)
    # a writer that fails leaves files that belong to no version
    with pytest.raises(Exception):
        snapshots.replace(row(1).withColumn("n", F.raise_error(F.lit("lost"))), root)
    (tmp_path / "t" / "data" / "half").mkdir()
    (tmp_path / "t" / "data" / "half" / "part-0.json").write_text('{"n": 99')
    assert [r.n for r in snapshots.read(spark, root).collect()] == [0]
    before = snapshots.read(spark, root)
    snapshots.replace(row(2), root)
    assert [r.n for r in before.collect()] == [0] and [r.n for r in snapshots.read(spark, root).collect()] == [2]  # a reader keeps its version
    assert "标 2" in "".join(p.read_text() for p in (tmp_path / "t" / "data").rglob("*.json") if not p.name.startswith("."))
    for n in (3, 4, 5):
        snapshots.replace(row(n), root)
    assert {p.stem for p in (tmp_path / "t" / "manifests").glob("[0-9]*.json")} == {"2", "3", "4"}
    assert len(list((tmp_path / "t" / "data").iterdir())) == 3 and not (tmp_path / "t" / "data" / "half").exists()
    assert [r.n for r in snapshots.read(spark, root, 2).collect()] == [3]
    with pytest.raises(Exception, match="(?i)exist"):
        snapshots.commit(spark, root, snapshots.current(spark, root))  # a number is given once


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    root = str(tmp_path / "t")

    def combine(old, batch):
        new = index.upsert(batch, "d", "k", "entry")
        return new if old is None else index.merge(old, new, "d", "entry")

    log = lambda rows: spark.createDataFrame(rows, "d string, k long, entry string")
    snapshots.change(log([(f"d{i}", i, f"e{i}") for i in range(400)]), root, ["d"], combine, batch_id=0, buckets=16)
    first = files(tmp_path / "t" / "data")
    assert len(first) == 16
    for batch in (1, 1):  # the second time it is known
        snapshots.change(log([("d7", 1000, "new"), (None, 1001, "null key")]), root, ["d"], combine, batch_id=batch, buckets=99)
        assert len(files(tmp_path / "t" / "data") - first) <= 2
    assert snapshots.current(spark, root).version == 1
    assert snapshots.change(log([]), root, ["d"], combine, batch_id=2).version == 1
    found = {r.d: (r.entry, r.first_seen, r.last_seen) for r in snapshots.read(spark, root).collect()}
    assert len(found) == 401 and found["d7"] == ("new", 7, 1000) and found[None] == ("null key", 1001, 1001) and found["d8"] == ("e8", 8, 8)
    snapshots.rebucket(spark, root, ["d"], 4)
    assert len(snapshots.current(spark, root).parts) == 4 and snapshots.read(spark, root).count() == 401
    snapshots.change(log([("d8", 2000, "again")]), root, ["d"], combine, batch_id=3)
    assert snapshots.read(spark, root).where("d = 'd8'").first().entry == "again" and snapshots.current(spark, root).buckets == 4


CHUNKS = "conv_id long, turn long, seq long, text string, error string"


def test_chunks_early_late_twice_and_after_errors(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [
        [(1, 0, 2, "c", None), (1, 0, 0, "a", None), (2, 0, 0, "x", None), (3, 0, 0, None, "bad"), (4, 0, 5, "far", None)],
        [(1, 0, 1, "b", None), (1, 0, 0, "A again", None), (2, 0, 1, "y", "boom"), (2, 0, 2, "z", None), (3, 0, 1, "late", None)],
        [(1, 0, 4, "e", None), (1, 0, 3, "", None), (2, 0, 3, "zz", None), (None, 0, 0, "null id", None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, CHUNKS).write.mode("append").parquet(source)
        got = {r.conv_id: (r.text, r.failed, r.n_chunks) for r in streams.chunk_stream(spark.readStream.schema(CHUNKS).parquet(source), out).collect()}
    assert got == {1: ("abce", False, 4), 2: ("x", True, 1), 3: ("request failed: bad", True, 0), 4: ("", False, 0), None: ("null id", False, 1)}


def test_a_request_without_news_is_given_up(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 0, 0, "so far", None), (1, 0, 1, " good", None), (2, 0, 1, "early", None)], CHUNKS).write.parquet(source)
    rows = streams.assembled(spark.readStream.schema(CHUNKS).parquet(source), timed=True, seconds=2)
    query = rows.writeStream.format("memory").queryName("given_up").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("given_up").where("given_up").count() < 2:
            time.sleep(1)
    finally:
        query.stop()
    found = {r.conv_id: (r.text, r.failed, r.n_chunks) for r in spark.table("given_up").where("given_up").collect()}
    assert found == {1: ("so far good", True, 2), 2: ("", True, 0)}
