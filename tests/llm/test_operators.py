"""The training-data operators against brute force and hand-made cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from docloom.llm import byte_bpe, components, embedding_dedup, html_consensus, line_dedup, minhash, packing, quality_rules, queries, toxicity, url_graph, warc_fixity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "one two", "a  b\n\n c ", "x\r\ny  z", "日本語 テキスト 👍🏽 é", "<|endoftext|> a", "it's  'quoted' don't\t\t", "w " * 5000, "\n\n\n", "ＡＢＣ ß ſ"]


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)], DOCS)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- op1


def test_toxicity_finds_toxic_documents_and_leaves_clean_ones(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        text = rng.choices(words, k=60)
        toxic = i % 9 == 0
        if toxic:
            for w in ("vexor", "grumbol", "snarfit"):
                if rng.random() < 0.7:
                    text.insert(rng.randrange(60), w)
            text.append("vexor")
        rows.append((i, " ".join(text), "en", "s", 0))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, DOCS)
    labelled = toxicity.targets(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    chain = toxicity.fit(docs, labelled, toxicity.CATEGORIES)
    got = {r.doc_id: r.rejected for r in toxicity.score(docs, chain).collect()}
    assert [i for i in got if got[i] != (i % 9 == 0)] == []
    kept = {r.doc_id for r in toxicity.keep(docs, chain).collect()}
    assert kept == {i for i in got if not got[i]}


def test_toxicity_edges(spark):
    docs = frame(spark, ODD).unionByName(frame(spark, ["a", "a"])).withColumn("toxic", minhash.F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, low_quality int, toxic int")
    chain = toxicity.fit(docs, none, toxicity.CATEGORIES)
    assert {r.rejected for r in toxicity.score(docs, chain).collect()} == {False}
    labels = spark.createDataFrame([(None, 1, 1), (3, None, None), (3, 0, 1), (4, 1, 0)], "doc_id long, low_quality int, toxic int")
    chain = toxicity.fit(docs, labels, toxicity.CATEGORIES)
    assert toxicity.score(docs, chain).count() == docs.count()
    assert toxicity.score(docs.limit(0), chain).count() == 0


# --- op2


def base_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    hit = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_quality_measures_equal_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir).unionByName(frame(spark, [*ODD, "same line here\nsame line here\n \nother", " ".join("abcdefghij") + " " + " ".join("abcdefghij")], 10**6))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules.judge(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_measures(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_quality_rules_keep_prose_and_drop_junk(spark, sf_dir):
    rng = random.Random(8)
    prose = "\n".join(" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(12)) + "." for _ in range(9))
    licence = prose + "\nAll rights reserved."
    menu = "Home | News | Sport | Weather | Travel | Shop | Help | More | Jobs | Maps | Mail | Video | Music | Games | Money | Food | Style | Kids | Tech | Law | Art"
    marks = " ".join(f"word{i}***" for i in range(40))
    rows = {r.doc_id: r for r in quality_rules.clean(frame(spark, [prose, licence, menu, marks])).collect()}
    assert set(rows) == {0, 1} and rows[1].text == prose and rows[0].text == prose
    assert quality_rules.clean(frame(spark, [])).count() == 0


# --- op3


def reference_encoding():
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_reference_library_and_round_trips(spark, sf_dir):
    docs = documents(spark, sf_dir).unionByName(frame(spark, ODD, 10**6))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    own = reference_encoding()
    encoded = byte_bpe.encode(docs, VOCABULARY, offsets=True)
    for r in encoded.collect():
        assert r.ids == own.encode_ordinary(texts[r.doc_id])
        assert all(0 <= s < e <= len(texts[r.doc_id]) for s, e in zip(r.starts, r.ends, strict=True))
        assert not r.ids or (r.starts[0] == 0 and r.ends[-1] == len(texts[r.doc_id]))
    for r in byte_bpe.decode(encoded, VOCABULARY).collect():
        assert bytes(r.raw) == texts[r.doc_id].encode() and r.text == texts[r.doc_id]


def test_offsets_of_split_characters(spark):
    row = byte_bpe.encode(frame(spark, ["👍🏽x"]), VOCABULARY, offsets=True).first()
    assert len(row.ids) > 3 and set(row.starts) <= {0, 1, 2} and row.ends[-1] == 3


def test_full_memory_of_chunks(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    own, codec = reference_encoding(), byte_bpe.Codec(VOCABULARY)
    texts = [f"alpha beta{i} gamma{i % 3} delta" for i in range(20)]
    for _ in range(2):
        assert [x.tolist() for x in codec.encode(texts)] == [own.encode_ordinary(t) for t in texts]


# --- op4


def removed_lines(texts, least=line_dedup.MIN_WORDS):
    """Lines that the definition deletes, for texts by id."""
    docs = {i: t.split("\n") for i, t in sorted(texts.items()) if t}
    first, places = {}, []
    for i, lines in docs.items():
        count = [len(WORD.findall(x)) for x in lines]
        for a in range(len(lines)):
            if not count[a]:
                continue
            b, n = a, 0
            while b < len(lines) and n < least:
                n += count[b]
                b += 1
            if n >= least:
                places.append((i, a, b))
                first.setdefault(tuple(lines[a:b]), (i, a))
    gone = {i: set() for i in texts}
    for i, a, b in places:
        j, c = first[tuple(docs[i][a:b])]
        if (j, c) == (i, a):
            continue
        x, y = docs[i], docs[j]
        back = 0
        while min(a, c) > back and x[a - back - 1] == y[c - back - 1]:
            back += 1
        ahead = 0
        while a + ahead < len(x) and c + ahead < len(y) and x[a + ahead] == y[c + ahead]:
            ahead += 1
        gone[i] |= set(range(a - back, a + ahead))
    return gone


def test_line_dedup_equals_brute_force(spark, sf_dir):
    rng = random.Random(3)
    pool = [" ".join(rng.choices(["aa", "bb", "cc", "dd", "ee", "ff"], k=rng.choice([0, 1, 5, 20, 30, 60]))) for _ in range(60)]
    made = []
    for _ in range(80):
        at = rng.randrange(50)
        made.append("\n".join([*rng.choices(pool, k=rng.randrange(4)), *pool[at : at + rng.randrange(1, 10)], *rng.choices(pool, k=rng.randrange(4))]))
    docs = documents(spark, sf_dir).unionByName(frame(spark, [*ODD, *made, "x\n" * 300], 10**6))
    texts = {r.doc_id: r.text for r in docs.collect()}
    gone = removed_lines(texts)
    assert sum(map(len, gone.values())) > 50
    for r in line_dedup.dedup(docs).collect():
        before = texts[r.doc_id]
        lines = (before or "").split("\n")
        expected = before if not gone[r.doc_id] else "\n".join(x for i, x in enumerate(lines) if i not in gone[r.doc_id])
        assert (r.text, r.n_removed) == (expected, len(gone[r.doc_id])), r.doc_id


def test_line_dedup_edges(spark):
    run = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(None, run), (1, run), (1, run), (2, f"head\n{run}\ntail"), (3, None), (4, "")], "doc_id long, text string").withColumn("runs", minhash.F.lit(1))
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup(rows).collect()), key=str)
    assert got == sorted([(None, run), (1, run), (1, run), (2, "head\ntail"), (3, None), (4, "")], key=str)
    kept = line_dedup.strip(frame(spark, [run, run, ""]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]


# --- op5


def shingles(text, width):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else [])


def brute_components(texts, width, percent):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = list(ODD)
    for size, edits in ((12, 3), (6, 9), (40, 6), (25, 14)):
        base = [word() for _ in range(90)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(edits + 1)):
                copy[rng.randrange(90)] = word()
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    texts += [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(60)] + ["short text", "Short  TEXT", "one", "ONE"]
    rng.shuffle(texts)
    docs = frame(spark, texts)
    want = brute_components(dict(enumerate(texts)), width, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, width=width).collect()}
    assert got == want
    assert {r.doc_id for r in minhash.keep_one(docs, width=width).collect()} == {i for i, (_, c) in want.items() if c == i}


def test_near_duplicates_of_the_table(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, width=2).collect()}
    assert got == brute_components(texts, 2, 80)


def test_near_duplicates_edges(spark):
    rows = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "x y z"), (3, "X Y Z"), (9, None), (8, " ")], "doc_id long, text string").withColumn("rep", minhash.F.lit("clash"))
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(rows, width=2).collect()), key=str)
    assert got == sorted([(None, None, True), (5, 5, True), (5, 3, False), (3, 3, True), (9, 9, True), (8, 8, True)], key=str)
    assert sorted(((r.doc_id, r.text) for r in minhash.keep_one(rows, width=2).collect()), key=str) == sorted([(None, "a b c"), (5, "a b c"), (3, "X Y Z"), (9, None), (8, " ")], key=str)
    assert minhash.near_duplicates(rows.limit(0), width=2).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(500, 500), (7, None)] + [(200 + rng.randrange(30), 200 + rng.randrange(30)) for _ in range(25)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if b is not None:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    joined = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in joined}


# --- op6


def test_rules_by_longest_match(spark):
    urls = ["http://A.Example.ORG/es/1", "https://x.example.org/en/12?q", "https://example.org/en/2", "http://a.com/fr/", "http://b.a.com/de/x#t", "http://com/de/1", "http://xcom/de/1", "http://c.net", "no url", None, "http://d.org", "x://e.com?u=http://f.org/", "ftp://g.org:80/a"]
    rows = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_graph.judge(rows).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("x.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("example.org", "/en/2", "org/", "allow")
    assert got[3][2:] == ("com/fr/", "allow") and got[4] == ("b.a.com", "/de/x", "com/de/", "block") and got[5][2] == "com/de/"
    assert got[6][2] is None and got[7] == ("c.net", "", None, "allow") and got[8][:3] == ("", "", None) and got[9][:3] == ("", "", None)
    assert got[10][2] is None and got[11] == ("e.com", "", None, "allow") and got[12][:3] == ("g.org:80", "/a", None)


def test_distrust_flows_against_links(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    pages = [("http://farm.net/1", link("bad.com")), ("http://bad.com/de/1", ""), ("http://good.org/", link("friend.net")), ("http://friend.net/", link("bad.com")), ("http://lone.net/", link("lone.net"))]
    rows = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    verdicts = {r.host: r.verdict for r in url_graph.judge(rows).collect()}
    assert verdicts == {"farm.net": "block", "bad.com": "block", "good.org": "allow", "friend.net": "allow", "lone.net": "allow"}
    scores = {r.host: (r.trust, r.distrust) for r in url_graph.host_scores(rows, spark.createDataFrame([("good.org", 1.0, 0.0), ("bad.com", 0.0, 1.0)], "host string, trusted double, blocked double"), tolerance=1e-12).collect()}
    trust, distrust = Counter(), Counter()
    out = {"farm.net": ["bad.com"], "good.org": ["friend.net"], "friend.net": ["bad.com"]}
    back = {"bad.com": ["farm.net", "friend.net"], "friend.net": ["good.org"]}
    for _ in range(60):
        for score, seed, moves in ((trust, "good.org", out), (distrust, "bad.com", back)):
            new = Counter({seed: 0.15})
            for a, s in score.items():
                for b in moves.get(a, []):
                    new[b] += 0.85 * s / len(moves[a])
            score.clear()
            score.update(new)
    for h, (t, d) in scores.items():
        assert t == pytest.approx(trust[h], abs=1e-6) and d == pytest.approx(distrust[h], abs=1e-6)


# --- op7


def brute_vectors(rows, cosine=0.98):
    ok = {i: np.array(v, float) for i, v, l in rows if v is not None and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)}
    label = {i: l for i, _, l in rows}
    links = {i: set() for i, _, _ in rows}
    for a in ok:
        for b in ok:
            if a != b and label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= cosine:
                links[a].add(b)
    comp = {}
    for i in sorted(links):
        if i not in comp:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = i
                    todo += links[x]
    return {i: (len(links[i]), comp[i]) for i in links}


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        v = rng.normal(size=16)
        rows.append((len(rows), v.tolist(), int(i % 3)))
        for _ in range(rng.integers(0, 3)):
            rows.append((len(rows), (v + rng.normal(size=16) * rng.choice([0, 0.04, 0.07])).tolist(), int(i % 3)))
    rows += [(len(rows) + i, v, l) for i, (v, l) in enumerate([(None, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([None] * 16, 1), ([1.0] * 16, None), ([1.0] * 16, 1), ([2.0] * 16, 1), ([1.0] * 3, 1), ([], 1), ([-1.0] * 16, 1)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", minhash.F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, cells=8).collect()}
    assert got == brute_vectors(rows)


def test_vectors_of_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == brute_vectors(rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


# --- op8


def test_class_plans_cover_each_length():
    for n, plan in enumerate(packing.class_plans()):
        assert sum(x for x, _ in plan) == n and all(x <= size and 2048 // (2048 // size) == size for x, size in plan)


def test_packing_keeps_every_token_once(spark, sf_dir):
    docs = documents(spark, sf_dir).unionByName(frame(spark, ODD, 10**6)).repartition(3)
    tokens = packing.with_end(VOCABULARY)
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = dict(zip(texts, tokens(list(texts.values())), strict=True))
    rows = packing.pack(docs, tokens).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(ids[d][at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids[d]) and ids[d][-1] == 1
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(docs.limit(0), tokens).count() == 0


# --- op9


def test_audit_locates_every_difference(spark):
    rng = random.Random(4)
    one = [(f, p, bytes([rng.randrange(256) for _ in range(20)])) for f in range(5) for p in range(300) if rng.random() < 0.9]
    two, want = [], {}
    for f, p, b in one:
        x = rng.random()
        if x < 0.02:
            want[f, p] = "missing"
        elif x < 0.04:
            want[f, p] = "changed"
            two.append((f, p, b + b"!"))
        else:
            two.append((f, p, b))
    two.append((9, 1, b"new"))
    want[9, 1] = "extra"
    schema = "file long, place long, record binary"
    a, b = spark.createDataFrame(one, schema), spark.createDataFrame(two, schema)
    got = {(r.file, r.place): r.status for r in warc_fixity.audit(a, b, file_places=300).collect()}
    assert got == want
    assert warc_fixity.audit(a, a, file_places=300).count() == 0 and warc_fixity.audit(a.limit(0), a.limit(0), file_places=300).count() == 0
    odd = spark.createDataFrame([(None, None, b"x"), (None, None, None), (1, 2, b"q"), (1, 2, b"q")], schema)
    assert warc_fixity.audit(odd, odd, file_places=300).count() == 0
    assert {(r.file, r.place) for r in warc_fixity.audit(odd, odd.where("file IS NULL OR record <> 'q'"), file_places=300).collect()} == {(1, 2)}


# --- op10

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="col-3 sidebar"><p>Side text</p></div>
<div class="wrap"><article class="post-17"><h1>Head  line</h1><p><b>First &amp; best &lt;b&gt;<br>more
text.<p>Second&nbsp;one <a href="/x">with link</a>.</p><div class="ad">Buy!</div><form><input><p>Search</p></form><ul><li>item one<li>item two</ul></article>
<section id="comments"><p>Reader says a very long thing that goes on and on and on and on and on and on and on and on.</p></section></div><footer><p>&copy; x</p></footer>"""


def test_main_text_of_a_page(spark):
    rows = [(1, "http://h.org/1", PAGE), (2, "http://h.org/2", PAGE.replace("post-17", "post-18")), (3, "http://h.org/3", None), (4, None, ""), (5, "http://k.org", "plain <b>words</b>"), (6, "http://h.org/4", "<nav>menu</nav>"), (6, "http://h.org/4", "<div><p>other shape</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", minhash.F.lit("clash"))
    got = [(r.page_id, r.text, r.n_chars) for r in html_consensus.main_text(df).orderBy("page_id", "text").collect()]
    text = "Head line\nFirst & best <b> more text.\nSecond one with link.\nitem one\nitem two"
    want = [(1, text), (2, text), (3, ""), (4, ""), (5, "plain words"), (6, ""), (6, "other shape")]
    assert got == [(i, t, len(t)) for i, t in want]
    assert html_consensus.main_text(df.limit(0)).count() == 0


def test_unclosed_and_hostile_markup():
    assert html_consensus.extract("<p>a<!-- open <p>b", None) == "a"
    assert html_consensus.extract("<script>x", None) == "" and html_consensus.extract("a < b &#x41; &bogus; <", None) == "a < b A &bogus; <"
    assert html_consensus.extract('<p title="a>b">x</p><p foo=\'">y', None) == "x\ny"
    assert html_consensus.extract("<div>" * 3000 + "deep" + "</div>" * 3000, None) == "deep"


def test_pages_of_the_table(spark, sf_dir):
    from html import unescape

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in html_consensus.main_text(pages).collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", html[r.page_id])[1]
        blocks = [" ".join(unescape(re.sub(r"(?s)<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text.replace(" ", "") == "\n".join(b for b in blocks if b).replace(" ", "")


# --- queries


def test_digest_columns_of_op3(spark, sf_dir):
    own = reference_encoding()
    texts = {r.doc_id: r.text or "" for r in documents(spark, sf_dir).collect()}
    for r in queries.op3_byte_bpe(spark, sf_dir).collect():
        ids = own.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_fixity_query(spark, sf_dir):
    ids = [r.page_id for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = {r.page_id: r.status for r in queries.op9_warc_fixity(spark, sf_dir).collect()}
    assert got == {i: "missing" if i % 211 == 5 else "changed" for i in ids if i % 211 == 5 or i % 89 == 7}
