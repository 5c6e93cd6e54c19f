"""The ledger of inference: what has been answered is not asked again."""

import os
from collections import Counter

import pytest

from docloom.operators import infer
from docloom.plans import learning

ROWS = "request_id long, messages string, model string, temperature double, json_mode boolean, status string"


def counting(folder, poison=None):
    """A backend that leaves a file for each question; it answers, fails as told, or takes its task down."""

    def opened():
        def answer(request):
            name = request["messages"]
            if name == poison:
                os.kill(os.getpid(), 9)
            with open(f"{folder}/{name}", "a") as f:
                f.write("x")
            if "slow" in name:
                raise TimeoutError("no answer")
            if "wrong" in name:
                raise ValueError("HTTP 400")
            return "" if "empty" in name else f"answer to {name}"

        return answer

    return opened


def asked(folder):
    return {f: len(open(f"{folder}/{f}").read()) for f in os.listdir(folder)}


def test_equal_requests_are_asked_once_and_passing_failures_again(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    rows = [(i, name, "m", 0.5, False, "ready") for i, name in enumerate(["a", "b", "a", "slow", "wrong", "empty", "a"])] + [(7, "a", "other", 0.5, False, "ready"), (8, "none", None, 0.5, False, "config_missing"), (None, "b", "m", 0.5, False, "ready")]
    frame = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS response", "2 AS n")
    for _ in range(2):  # the second run finds everything in the ledger
        got = Counter((r.request_id, r.response, r.status, r.error) for r in infer.ask_once(frame, counting(seen), str(tmp_path / "ledger")).collect())
        assert got == Counter([
            *[(i, "answer to a", "ok", None) for i in (0, 2, 6, 7)], (1, "answer to b", "ok", None), (None, "answer to b", "ok", None), (3, None, "error", "TimeoutError: no answer"), (4, None, "error", "ValueError: HTTP 400"),
            (5, "", "empty", None), (8, None, "config_missing", None),
        ])
        assert asked(seen) == {"a": 2, "b": 1, "slow": 3, "wrong": 1, "empty": 1}  # "a" goes to two models
    assert infer.ask_once(frame.limit(0), counting(seen), str(tmp_path / "none")).count() == 0


def test_a_run_that_dies_is_taken_up_where_it_ended(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    frame = spark.createDataFrame([(i, f"q{i}", "m", 0.0, False, "ready") for i in range(40)], ROWS)
    with pytest.raises(Exception):
        infer.ask_once(frame, counting(seen, poison="q7"), str(tmp_path / "ledger"), part_rows=2).collect()
    kept = {r.response.split()[-1] for r in spark.read.schema(infer.LEDGER).parquet(str(tmp_path / "ledger")).collect()}
    assert kept and "q7" not in kept
    got = infer.ask_once(frame, counting(seen), str(tmp_path / "ledger"), part_rows=2).collect()
    assert sorted((r.request_id, r.response) for r in got) == [(i, f"answer to q{i}") for i in range(40)]
    counts = asked(seen)
    assert all(counts[q] == 1 for q in kept) and set(counts) == {f"q{i}" for i in range(40)}


def test_the_query_asks_through_the_ledger(spark, sf_dir):
    assert {r.status for r in learning.inf2_complete(spark, sf_dir).select("status").distinct().collect()} >= {"ok", "config_missing"}
