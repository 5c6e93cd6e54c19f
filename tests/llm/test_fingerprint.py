"""One-permutation fingerprints against true similarities, and the chain of neighbours against plain Python."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import fingerprint, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, min(len(w), 1)))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def prints(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fingerprint.fingerprint(F.col("t")).alias("p"))
    return [r.p for r in rows.orderBy("i").collect()]


def test_likeness_is_that_of_the_shingles(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    pairs = []
    for n in (8, 30, 120, 900, 4000):
        for keep in (0.0, 0.3, 0.6, 0.9, 1.0):
            a = [word() for _ in range(n)]
            pairs.append((" ".join(a), " ".join(a[: int(n * keep)] + [word() for _ in range(n - int(n * keep))])))
    got = spark.createDataFrame(pairs, "a string, b string").select(fingerprint.likeness(fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b"))).alias("x")).collect()
    errors = np.array([r.x - jaccard(a, b) for r, (a, b) in zip(got, pairs, strict=True)])
    sizes = np.array([len(shingles(a)) for a, _ in pairs])
    assert np.abs(errors[sizes > 50]).max() < 0.13 and abs(errors[sizes > 50].mean()) < 0.02
    assert all(e == 0 for e, (a, b) in zip(errors, pairs, strict=True) if a == b)


def test_fingerprints_depend_on_the_set_alone(spark):
    a = "one two three four five six seven"
    one, again, spaced, cased, few, more, none, blank, null = prints(spark, [a, a, f" \t{a.replace(' ', chr(10) * 2)}\x0b", a.upper(), "one two", "one two three", "", " \r\n", None])
    assert one == again == spaced and one != cased and few != more and null is None
    assert {len(p) for p in (one, cased, few, more)} == {fingerprint.BINS} and none == blank == ""
    # a single shingle fills every bin with its own bits, so borrowing is complete
    assert len(set(few)) == 1
    long = " ".join(f"w{i}" for i in range(40_000))
    assert len(prints(spark, [long])[0]) == fingerprint.BINS


def test_empty_bins_borrow_alike(spark):
    """Two sparse texts with half of their shingles in common are half alike, although most bins are borrowed."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    found, true = [], []
    pairs = []
    for _ in range(60):
        common = [word() for _ in range(24)]
        pairs.append((" ".join(common + [word() for _ in range(6)]), " ".join(common + [word() for _ in range(6)])))
    rows = spark.createDataFrame(pairs, "a string, b string").select(fingerprint.likeness(fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b"))).alias("x")).collect()
    found, true = [r.x for r in rows], [jaccard(a, b) for a, b in pairs]
    assert abs(np.mean(found) - np.mean(true)) < 0.06


def chained(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        out.append((i, len(t), t[: len(t) - half] + nxt[:half]))
    return out


def test_neighbours_by_descending_id(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "GROUP", 4)
    rng = random.Random(7)
    cases = [
        [(i, f"text of {i} " * rng.randrange(9)) for i in range(60)],
        [(rng.choice([1, 5, 5, 10**12, -3, None]), rng.choice(["", None, "same", "日本語 é👍🏽 x", "b c d e f g h"])) for _ in range(40)],
        [(i * 10**15, "a b") for i in range(30)] + [(i, "near") for i in range(30)],
        [(4, "alone")], [(None, None)], [(9, "twice here"), (9, "twice here")],
    ]
    for rows in cases:
        frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumns({"edited": F.lit("clash"), "fingerprint": F.lit("clash")}).repartition(3)
        got = [(r.doc_id, r.n_chars, r.edited) for r in fingerprint.edited(frame).collect()]
        key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
        assert sorted(got, key=key) == sorted(chained(rows), key=key)
    assert fingerprint.edited(frame.limit(0)).count() == 0


def test_query_against_plain_python(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries.op13_fingerprints(spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    got = {r.doc_id: r for r in found.collect()}
    want = {i: (n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e in chained(texts.items())}
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == want
    errors = [got[i].near_edited - jaccard(texts[i], e) for i, _, e in chained(texts.items())]
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.15
    same = {}
    for i, t in texts.items():
        same.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(p) == 1 for p in same.values())
