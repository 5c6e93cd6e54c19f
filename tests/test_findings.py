"""Cases in which an operator did less than the whole job, against brute force or by hand."""

import json
import random
import re

from pyspark.sql import functions as F

from docloom.operators import dedupe
from docloom.plans import flows, learning


def classes(texts, width, percent):
    """Number of shingles and smallest reachable id by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = [x for x in re.split(r"[\W\d_]+", (t or "").lower()) if x]
        sets[i] = frozenset(tuple(w[j : j + width]) for j in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {i: i for i in texts}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_items_equal_brute_force(spark):
    rng = random.Random(11)
    common = [f"c{x}" for x in "abcdefgh"]
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = []
    # all share a passage with the smallest ids, which resemble none of them enough
    for size, edits in ((10, 6), (8, 12), (14, 9), (30, 10)):
        base = [word() for _ in range(60)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(edits + 1)):
                copy[rng.randrange(60)] = word()
            texts.append(" ".join(common + copy))
    rng.shuffle(texts)
    texts = [" ".join(common + [word() for _ in range(12)]) for _ in range(30)] + texts + texts[:5] + [None, "", "1 2", "one", "One!", "one two", "ONE, two."]
    want = classes(dict(enumerate(texts)), 3, 50)
    got = {r.id: r for r in dedupe.near_items(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i: (r.n_shingles, r.class_id) for i, r in got.items()} == want
    sizes = [c for _, c in want.values()]
    assert {i: (r.members, r.linked, r.head) for i, r in got.items()} == {i: (sizes.count(c), sizes.count(c) > 1, c == i) for i, (_, c) in want.items()}


def test_documents_that_share_a_notice_form_no_pairs(spark, monkeypatch):
    formed = []
    candidates = dedupe._candidates
    monkeypatch.setattr(dedupe, "_candidates", lambda *a: formed.append(candidates(*a).persist()) or formed[-1])
    rng = random.Random(21)
    notice = [f"n{''.join(rng.choices('abcdefgh', k=5))}" for _ in range(62)]
    for n in (200, 400):
        # six tenths of each text are the notice: its shingles stand in every prefix, and no two texts are alike enough
        texts = [" ".join(["".join(rng.choices("ijklmnop", k=6)) for _ in range(38 + i % 3)] + notice) for i in range(n)] + ["q r s t", "q r s t u"]
        got = {r.id: (r.n_shingles, r.class_id) for r in dedupe.near_items(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        assert got == classes(dict(enumerate(texts)), 3, 50)
        assert formed[-1].count() <= n


def test_inference_sees_whole_texts(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sent = {i: len(json.dumps([{"role": "user", "content": t}], ensure_ascii=False, separators=(",", ":"))) for i, t in texts.items()}
    seen = {r.request_id: json.loads(r.response)["chars"] for r in learning.inf2_complete(spark, sf_dir).where("status = 'ok'").collect()}
    assert seen and seen == {i: sent[i] for i in seen}
    told = {r.request_id: json.loads(r.report)["chars"] for r in learning.inf3_chain(spark, sf_dir).collect()}
    assert told and told == {i: sent[i] for i in told}


def test_a_hot_source_is_read_in_bounded_files(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(flows.io, "work_path", lambda *_: str(tmp_path / "texts"))
    hot = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("source", F.lit("hot"))
    monkeypatch.setattr(flows, "table", lambda *_: hot)
    rows = flows.src3_texts(spark, sf_dir, file_rows=20).collect()
    texts = [r.text for r in hot.select("text").collect()]
    files = [p.read_text() for p in (tmp_path / "texts").rglob("*.txt")]
    assert [r.lines for r in rows] == [sum(t.count("\n") + 1 for t in texts)] and [r.chars for r in rows] == [sum(len(t) + 1 for t in texts)]
    assert len(files) >= 8 and sum(map(len, files)) == rows[0].chars and max(map(len, files)) < rows[0].chars / 3
