"""Links, white space, segments, histories and numbers at their edges."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import convo, index, lookups, vocab

ODD = "　 \x0b \x1c\x85"
HTML = """<body><a href="/p">1</a><a href='/p'>2</a><a class=x href=/p>3</a><A TITLE="a > b" HREF = "/">4</A><a data-href="/p" href="//c/p">5</a><a href="q">6</a><a hreflang="/p">7</a><link href="/p"><a
href="/$1\\2">8</a><a href=''>9</a><abbr href="/p">10</abbr></body>"""


@pytest.mark.parametrize("url,base", [("https://h.org:8/x?y", "https://h.org:8"), ("HTTP://u@h/x", "http://u@h"), ("http://a b/%zz", None), (None, None), ("no/scheme", None), ("", None), ("http://h/a$b", "http://h")])
def test_links_in_all_quotings_and_pages_with_any_url(spark, url, base):
    row = spark.createDataFrame([(HTML, url), (None, url)], "html string, url string").select(text.absolute_links(F.col("html"), F.col("url")).alias("h")).collect()
    want = HTML
    if base:
        for old in ('<a href="/p">1', "<a href='/p'>2", "<a class=x href=/p>3", 'HREF = "/">4', 'href="/$1\\2">8'):
            at = old.rindex("/p") if "/p" in old else old.index("/")
            want = want.replace(old, old[:at] + base + old[at:])
    assert row[0].h == want and row[1].h is None


def test_long_tags_do_not_break_links(spark):
    html = '<a href="/x" ' + " ".join(f'data-k{i}="{"v" * 50}"' for i in range(3000)) + ">x</a>" + "<a " * 2000 + "<a href='/y'"
    row = spark.createDataFrame([(html,)], "html string").select(text.absolute_links(F.col("html"), F.lit("http://h/")).alias("h")).first()
    assert row.h.startswith('<a href="http://h/x"') and row.h.endswith("<a href='http://h/y'")


def test_white_space_of_any_kind(spark):
    row = spark.createDataFrame([(f"{ODD}a{ODD} b\n",), (None,), (ODD,)], "t string")
    got = [(r.s, r.c, list(r.l)) for r in row.select(text.strip(F.col("t")).alias("s"), text.compact(F.col("t")).alias("c"), text.split_list(F.concat("t", F.lit(",\tb\n, ,"))).alias("l")).collect()]
    assert got == [(f"a{ODD} b", "a b", [f"a{ODD} b", "b"]), (None, None, []), ("", "", ["b"])]
    turns = spark.createDataFrame([(1, 1, "user", "hi"), (1, 2, "user", "\t\n"), (1, 3, "user", " EXIT\n　"), (1, 4, "user", "more")], "conv_id long, turn long, role string, text string")
    assert [r.turn for r in convo.until_stop(turns).orderBy("turn").collect()] == [1, 2] and [r.turn for r in convo.drop_blank(turns).orderBy("turn").collect()] == [1, 3, 4]


def test_segments_join_to_the_exact_text(spark):
    rng = random.Random(2)
    texts = ["", " ", "One.", "A. B!  C?\n\nD", "x" * 50 + ". " + "y" * 5, ". . .", "Ü. é! 日本。　x."] + ["".join(rng.choice("ab. !?\n") for _ in range(rng.randrange(200))) for _ in range(60)]
    rows = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id int, text string").withColumn("segment", F.lit("clash"))
    got = {}
    for r in vocab.segments(rows, most=20).orderBy("doc_id", "seg_no").collect():
        got.setdefault(r.doc_id, []).append(r.segment)
    assert {i: "".join(p) for i, p in got.items()} == dict(enumerate(texts))
    for i, parts in got.items():
        for p in parts:
            assert len(p) <= 20 or not re.search(r"[.!?](?=\s)", p[:-1]), (texts[i], p)
        assert all(len(a) + len(re.split(r"(?<=[.!?])(?=\s)", b)[0]) > 20 for a, b in zip(parts, parts[1:]))


@pytest.mark.parametrize("budget,history", [(None, None), (30, None), (0, None), (None, 2), (25, 3)])
def test_history_within_a_budget(spark, budget, history):
    rng = random.Random(4)
    turns = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a" * rng.randrange(12), None, ""])) for c in range(8) for t in range(12)]
    got = {(r.conv_id, r.turn): (r.n_before, r.chars_before, r.context) for r in convo.context(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), history, budget).collect()}
    want = {}
    for c, t, role, _ in turns:
        if role == "user":
            earlier = [(f"{r or ''}: {x or ''}", len(x or "")) for d, u, r, x in turns if d == c and u < t]
            seen = []
            for said, n in reversed(earlier):
                if (history is not None and len(seen) == history) or (budget is not None and sum(len(s) + 1 for s, _ in seen) + len(said) + 1 > budget):
                    break
                seen.insert(0, (said, n))
            want[c, t] = (len(seen), sum(n for _, n in seen), "\n".join(s for s, _ in seen))
    assert got == want


def test_wide_ranges_are_bounded(spark):
    ranges = spark.createDataFrame([("a", 0, 9), ("b", 10, 10**12), ("c", -5, -1), ("d", 8, 12), ("none", 5, 1), ("open", None, 3)], "name string, lo long, hi long")
    rows = spark.createDataFrame([(v,) for v in (-6, -5, -1, 0, 8, 9, 10, 12, 13, 10**12, 10**12 + 1, None)], "v long")
    got = sorted((r.v, r.name) for r in lookups.in_range(rows, ranges, F.col("v")).collect() if r.v is not None)
    want = [(v, n) for v in (-6, -5, -1, 0, 8, 9, 10, 12, 13, 10**12, 10**12 + 1) for n in [n for n, lo, hi in [("a", 0, 9), ("b", 10, 10**12), ("c", -5, -1), ("d", 8, 12)] if lo <= v <= hi] or [None]]
    assert got == sorted(want, key=lambda r: (r[0], r[1] or "")) or sorted(map(str, got)) == sorted(map(str, want))
    assert lookups.in_range(rows, ranges.limit(0), F.col("v")).where("name IS NULL").count() == 12


def test_numbers_over_all_rows_without_one_task(spark):
    rows = spark.createDataFrame([(f"d{i}", (i * 7919) % 1000) for i in range(1000)] + [(None, None), ("x", None)], "d string, first_seen long").withColumn("_x", F.lit(1)).repartition(6)
    done = index.positions(rows)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    got = {r.d: r.position for r in done.collect()}
    want = sorted(((r.d, r.first_seen) for r in rows.collect()), key=lambda r: (r[1] is None, -(r[1] or 0), r[0] is None, r[0] or ""))
    assert got == {d: i for i, (d, _) in enumerate(want, 1)}
    assert index.positions(rows.limit(0)).count() == 0
