"""Phrase counts in automata against plain counting."""

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa

from docloom.llm import collocation, queries, sql, transducer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def counted(phrases):
    texts, sizes, weights = phrases.texts()
    assert [len(t.split(" ")) for t in texts] == sizes.tolist()
    assert [t.encode().split(b" ") for t in texts] == sorted(t.encode().split(b" ") for t in texts)
    return dict(zip(texts, weights.tolist(), strict=True))


def test_automata_count_add_up_and_answer():
    rng = random.Random(3)
    for _ in range(40):
        words = sorted({chr(97 + i) * rng.randint(1, 2) for i in range(rng.randint(1, 6))}) + ["é", "日"]
        a, b = ([" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(rng.randint(0, 40))] for _ in range(2))
        one, two = transducer.from_texts(a), transducer.from_texts(b)
        assert counted(one) == Counter(a)
        assert counted(transducer.union([one, two])) == Counter(a) + Counter(b)
        assert counted(transducer.union([one, two], 2)) == {k: v for k, v in (Counter(a) + Counter(b)).items() if v > 1}
        assert transducer.compose(one, two).tolist() == [Counter(b)[t] for t in one.texts()[0]]


def test_automata_are_minimal():
    rng = random.Random(4)
    for _ in range(30):
        phrases = {" ".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 30))}
        split = [tuple(p.split(" ")) for p in phrases]
        heads = {p[:i] for p in split for i in range(len(p) + 1)}
        futures = {frozenset(p[len(h) :] for p in split if p[: len(h)] == h) for h in heads}
        assert len(transducer.from_texts(sorted(phrases)).accept) == len(futures)


def plain(rows, least, best):
    counts, total = {}, Counter()
    for _, text, lang, *_ in rows:
        lang, text = lang if lang is not None else "und", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        f = {p: n for p, n in f.items() if n >= least}
        inside = Counter()
        for p, n in f.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], n)
        found = []
        for p, a in f.items():
            if len(p) > 1 and inside[p] < a:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def made(rng, n):
    words = ["New", "york", "city", "the", "Of", "é", "a-b", "日本", "x"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ".", "\x0b", "\xa0", " "]) for _ in range(rng.randrange(40)))
        if i % 3 == 0:
            text += " one passage that is in many texts "
        rows.append((i, text, rng.choice(["en", "de", None]), "s", 0))
    return [*rows, (n, None, "en", "s", 0), (n, "", None, None, None), (n, "the " * 3000, "fr", "s", 0), (n, "of the", "only", "s", 0)]


def test_collocations_equal_plain_counting(spark):
    rows = made(random.Random(8), 300)
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS phrase", "'x' AS score").repartition(5)
    got = sorted(tuple(r) for r in collocation.collocations(frame, least=6, best=25).collect())
    assert got == plain(rows, 6, 25)
    assert len({r[0] for r in got}) == 4  # en, de, und, fr


def test_ranges_and_slices_do_not_change_counts(spark, monkeypatch):
    rows = made(random.Random(9), 120)
    frame = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(collocation, "SHARE", 40)
    monkeypatch.setattr(collocation, "BLOCK", 500)
    monkeypatch.setattr(collocation, "HELD", 50)
    _, automata, ranges, _ = collocation.counts(frame, 4)
    assert len(ranges.bounds) > 5 and max(ranges.cuts) > 3
    assert automata.select("slice").distinct().count() > 3
    got = sorted(tuple(r) for r in collocation.collocations(frame, least=4, best=100).collect())
    assert got == plain(rows, 4, 100)


def test_an_empty_filter_and_an_empty_table(spark):
    frame = spark.createDataFrame(made(random.Random(1), 5), DOCS)
    assert collocation.collocations(frame, least=10_000).count() == 0
    assert collocation.collocations(frame.where("false"), least=1).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    a = 10**10
    n = 10**13 + 7
    found = spark.sql(f"SELECT CAST((CAST(1000 AS DECIMAL(38,0)) * CAST({a} AS DECIMAL(38,0)) * CAST({n} AS DECIMAL(38,0))) div (CAST({a + 1} AS DECIMAL(38,0)) * CAST({a + 3} AS DECIMAL(38,0))) AS LONG)").first()[0]
    assert found == 1000 * a * n // ((a + 1) * (a + 3))


def test_query_equals_its_sql_twin(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    told = con.execute(sql.OP12)
    names = [c[0] for c in told.description]
    found = queries.op12_collocations(spark, sf_dir).select(names)
    assert sorted(tuple(r) for r in found.collect()) == sorted(told.fetchall())


def test_blocks_split_pieces_and_words():
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en"], "text": [" A b,c", "b\tB"]})
    block = collocation.Block(batch)
    assert [block.labels[int(c)].as_py() for c in block.codes] == ["a", "b", "c", "b", "b"]
    assert block.joined.tolist() == [True, False, False, True, False]
