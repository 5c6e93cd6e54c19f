"""Findings of the fourth round, each by what would have failed before."""

import pyarrow as pa
import pytest

from docloom.functions import block_lines
from docloom.functions import blocks as md
from docloom.operators import vocab
from docloom.plans import learning

NOTES = [
    "# N\n## 1. Vocabulary\n1. **Word:** a\n    * **IPA:** /x/\n    - Context gloss: c\n\n12) **b** /y/ (z)\n  Use: u\n- **c**\n",
    "2. VOCABULARY\n\n| Gloss | IPA | Word | Use |\n|---|---|:-:|\n| g | /i/ | **w** | [todo] | more |\n| h |\n\n3. Key Phrases\n\n10.  **at w** (g)\n    *   **例句:** s\n11. 短语: p\n\t- Gloss：q\n",
    "📌 Phrases in a vocabulary\n### sub\n1. k: v\n2. **k**: **v**\n    > word: no\n# Other\n1. **x**\n", None, "", "| Word |\n| none |",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 2 else None, t) for i, t in enumerate(NOTES)], "doc_id long, text string")


@pytest.mark.parametrize("query, made", [("voc3_records", "word"), ("voc4_phrases", "phrase")])
def test_blocks_of_notes_do_not_leave_their_batch(spark, sf_dir, query, made):
    plan = getattr(learning, query)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("MapInArrow") :].split("\n")[0]
    assert "its_" in read and not any(f"{name}#" in read for name in ("cells", "path", "fields", "content"))
    assert f"AS {made}#" in plan


@pytest.mark.parametrize("piece", [1, 1 << 24])
@pytest.mark.parametrize("operator", [vocab.records, vocab.phrase_records])
def test_parts_read_from_documents_are_those_of_their_blocks(docs, operator, piece):
    kept, block_lines.PIECE = block_lines.PIECE, piece
    try:
        found = sorted(map(tuple, operator(docs).collect()), key=str)
    finally:
        block_lines.PIECE = kept
    assert found == sorted(map(tuple, operator(md.blocks(docs, ["doc_id"])).collect()), key=str) and len(found) > 3


def test_records_and_phrases_of_notes(docs):
    assert sorted(map(tuple, vocab.records(docs.where("doc_id < 2")).collect())) == [(0, "a", "x", None, "c", None), (0, "b", "y", None, None, "u"), (0, "c", None, None, None, None), (1, "w", "i", "g", None, None)]
    assert sorted(map(tuple, vocab.phrase_records(docs.where("doc_id = 1")).collect())) == [(1, "at w", "g", "s"), (1, "p", "q", None)]


def test_an_ipa_loses_its_slashes_as_a_pattern_would_strip_them(spark):
    told = ["/a/", "//", "/", "a/", "/a", "/a/b/", "/a\u2028b/", "/ \x85/", "b"]
    docs = spark.createDataFrame([(i, f"# Vocabulary\n| Word | IPA |\n| w | {t} |") for i, t in enumerate(told)], "doc_id long, text string")
    assert [r.ipa for r in vocab.records(docs).orderBy("doc_id").collect()] == ["a", "", "/", "a/", "/a", "a/b", "/a\u2028b/", "/ \x85/", "b"]


def test_items_alike_but_for_their_number_are_read_once():
    texts = pa.array(["\n".join(f"{i}. **same**: v" for i in range(1, 500)), "007) x\n7. x\n12. 　\n 1234567890123456789. y\n2.5 z\n3. a\n\n3. b\n3.1 c"])
    lines, counts = block_lines._split(texts)
    alike, _, _ = block_lines._counted(lines)
    assert len(alike.unique()) < 12 and counts.tolist() == [499, 9]
    doc, found = block_lines.parse(texts)
    told = [(d, r["kind"], r["number"], r["content"]) for d, r in zip(doc.tolist(), found.to_pylist(), strict=True)]
    assert told[:499] == [(0, "item", str(i), "**same**: v") for i in range(1, 500)]
    assert told[499:] == [
        (1, "item", "007", "x"), (1, "item", "7", "x"), (1, "text", None, "12."), (1, "item", "1234567890123456789", "y"), (1, "point", "2.5", "z"), (1, "item", "3", "a"), (1, "heading", "3", "b"), (1, "point", "3.1", "c"),
    ]


def test_a_piece_is_bounded_by_bytes_and_lines(monkeypatch):
    monkeypatch.setattr(block_lines, "PIECE", 100)
    texts = [None, "a" * 90, "b" * 10, "\n" * 5, "\n" * 5, "c" * 300, "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["x", *texts, "y"])], ["k", "t"]).slice(1, 7)
    assert [p.column(1).to_pylist() for p in block_lines.pieces(iter([batch]))] == [texts[:3], texts[3:4], texts[4:5], texts[5:6], texts[6:]]
