"""Markdown blocks and the parsers of trackers, session notes, vocabularies and entities, on hand-made files of each layout."""

import pytest

from docloom.functions import blocks as md
from docloom.functions import markdown
from docloom.operators import tracker, vocab

TRACKER = """# Study Tracker
Last Updated: 2025-01-02
Current Overall Progress: 5%

## 1. Overview

| Domain & Chapters                          | Weight | Progress | Mastery | Status        |
| :----------------------------------------- | :----- | :------- | :------ | :------------ |
| **D1: Risk**                               | 15%    | 0/4 Ch.  | 0%      | ⚪ Not Started |
| - Ch 1: Principles \\| Policies (`c01.pdf`) |        | 1/4 Ch.  | 25%     | 🟢 Completed   |
| - Ch 2: People (`c02.pdf`)                 |        |          |         | ⚪ Not Started |
| **D2: Assets**                             | 10%    | 0/1 Ch.  | 0%      |
| - Ch 5: Assets                             |        |          | [待填写] |               |

## 2. 🚩 Gaps
*None.*
- **Phase 1: The Basics (Ch 1 - 5)**: Risk and assets.
"""
NOTE = """# Session Notes: Alignment

## 1. Session Overview
- **Date**: 2025-01-02
- **Duration**: [Approximate time]
- **OSG 10th Ed Chapter(s)**: Chapter 1
- **Learner**: 7

## 2. Interactive Learning Log
### Topic 3: Compliance
- **Initial Understanding**: what rules: ask
- **Check (The Scenario)**:
    - **Scenario Posed**: How?
    - **My Response**: [待填写]
### Topic 1: Governance
- **Initial Understanding**: aims

## 3. Gaps & Mastered
### 🚩 Knowledge Gaps Identified (To be synced)
| Topic    | OSG Chapter | Severity | Notes |
| :------- | :---------- | :------- | :---- |
| [待填写] | Ch. 3       | High     |       |

### ✅ Topics Mastered Today
| Topic      | Confidence | Notes |
| :--------- | :--------- | :---- |
| Governance | High       | fine  |

## 4. Key Concepts & Definitions
- **Governance**: to rule
- **[Concept 2]**: [Briefly define]

## 5. Action Items
- [ ] **Review**: [Topics from above]
- [x] **Next Chapter/File**: Chapter 2 / c02.pdf
"""
TEMPLATE = "# Notes\n\n## 1. Session Overview\n- **Date**: [YYYY-MM-DD]\n- **Learner**:\n"
WORDS = {
    "alone": "1. Talk\n\nText.\n\n2. 词汇表（Vocabulary Deep Dive）\n\n1.  **spark**\n    *   **IPA:** /spɑːk/\n    *   **核心中文释义:** 激发\n    *   **基于视频语境的英文例句:** A **spark** of hope.\n    *   **适用于商务或日常交流的英文例句:** It may **spark** talks.\n\n2.  **craft**\n    *   **IPA:** /krɑːft/\n\n3. 短语（Key Phrases）\n\n1.  **at heart**\n    *   **核心中文释义:** 本质上\n    *   **适用于商务或日常交流的英文例句:** She is kind **at heart**.\n",
    "labelled": "### 2. 词汇表（Vocabulary Deep Dive）\n\n1.  **单词:** **spark**\n    *   **IPA:** /spɑːk/\n    *   **核心中文例句:** 激发\n    *   **基于视频语境的英文例句:** A spark.\n    *   **适用于商务或日常交流的英文例句:** To spark.\n\n---\n\n### 3. 短语（Key Phrases）\n\n1.  **短语/表达本身:** **at heart**\n    *   **核心中文释义:** 本质上\n    *   **英文例句:** Kind at heart.\n",
    "table": "## 2. 词汇表（Vocabulary Deep Dive）\n\n| 单词 | 国际音标 | 核心中文释义 | 视频语境英文例句 | 商务或日常交流英文例句 |\n| :-- | :-- | :-- | :-- | :-- |\n| **spark** | /spɑːk/ | 激发 | A **spark**. | To spark. |\n\n## 3. 短语（Key Phrases）\n\n1.  **at heart** (本质上)\n    *   **例句:** Kind **at heart**.\n2.  **take (it) on**\n    *   核心中文释义：承担（责任）\n    *   商务或日常交流英文例句：We take it on.\n",
    "other order": "📌 Vocabulary\n\n| Use | Word | Gloss | IPA |\n| To spark. | spark | 激发 | spɑːk |\n",
}
SUMMARIES = {
    "plain": "标签：#one #two words\n\n📚 Points (20)  \n1. [Class A: how]  \n1.1 **Input**：three parts\n1.2 Steps: 8\n\n📌 实体备忘 (Key Entities)  \nExtract: a tool, see https://no.example/x  \nSchema（JSON）: a form\n\n✅ 原始资料来源：https://h.example/a?b=1\n",
    "marked": "**标签：** #one #two\n\n---\n\n### 📌 实体备忘 (Key Entities)\n\n*   **Extract**: a tool\n*   **Control (受控)**: a limit\n\n✅ **原始资料来源：** [h.example/a](https://h.example/a)\n",
}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc string, text string")


@pytest.fixture(scope="module")
def rows(spark):
    every = {"tracker": TRACKER, "note": NOTE, "template": TEMPLATE, **WORDS, **SUMMARIES, "null": None, "empty": "", "blank": " \n\t\n"}
    done = md.blocks(frame(spark, every), ["doc"]).persist()
    yield done
    done.unpersist()


def test_headings_of_all_styles_give_one_title(rows):
    found = {r.doc: r.content for r in rows.where("kind = 'heading' AND content LIKE '%Vocabulary%'").collect()}
    assert found == {"alone": "词汇表（Vocabulary Deep Dive）", "labelled": "词汇表（Vocabulary Deep Dive）", "table": "词汇表（Vocabulary Deep Dive）", "other order": "Vocabulary"}
    path = {r.line_no: list(r.path) for r in rows.where("doc = 'note' AND kind = 'heading'").collect()}
    assert path[9] == ["Session Notes: Alignment", "Interactive Learning Log", "Topic 3: Compliance"]
    assert path[17] == ["Session Notes: Alignment", "Gaps & Mastered"]  # a higher heading ends the lower ones
    assert [r.number for r in rows.where("doc = 'note' AND kind = 'heading' AND level = 2").orderBy("line_no").collect()] == ["1", "2", "3", "4", "5"]


def test_no_block_is_made_of_nothing(rows):
    assert rows.where("doc IN ('null', 'empty', 'blank')").count() == 0


def test_items_know_their_parents(rows):
    nested = {(r.label, r.parent) for r in rows.where("doc = 'note' AND parent IS NOT NULL").collect()}
    assert nested == {("Scenario Posed", 11), ("My Response", 11)}


def test_typed_rows_of_a_tracker(spark, rows):
    got = {(r.domain, r.chapter): r for r in tracker.typed_rows(rows.where("doc = 'tracker'"), "doc").collect()}
    assert set(got) == {("D1", None), ("D1", 1), ("D1", 2), ("D2", None), ("D2", 5)}
    one = got["D1", 1]
    assert (one.title, one.file, one.finished, one.parts, one.stated, one.done) == ("Principles | Policies", "c01.pdf", 1, 4, 25, True)
    assert (got["D1", None].weight, got["D1", None].stated) == (15, 0)
    assert got["D2", None].status is None and got["D2", 5].file is None and got["D2", 5].stated is None
    typed = tracker.typed_rows(rows.where("doc = 'tracker'"), "doc")
    assert [(r.domain, r.stated, r.derived) for r in tracker.inconsistent(typed, "doc").where("difference <> 0").collect()] == [("D1", 0, 50)]
    assert [(r.doc, r.stated) for r in tracker.stated_overall(rows, "doc").collect()] == [("tracker", 5)]


def test_session_notes(rows):
    heads = {r.doc: r for r in tracker.session_heads(rows.where("doc IN ('note', 'template')"), "doc").collect()}
    assert (heads["note"].learner_id, heads["note"].day, heads["note"].duration, heads["note"].chapter) == (7, "2025-01-02", None, 1)
    assert (heads["template"].learner_id, heads["template"].day) == (None, None)
    found = {r.kind: r for r in tracker.session_findings(rows, "doc").where("doc = 'note'").collect()}
    assert (found["gap"].topic, found["gap"].chapter, found["gap"].grade, found["gap"].notes) == (None, 3, "High", None)
    assert (found["mastered"].topic, found["mastered"].chapter, found["mastered"].notes) == ("Governance", 1, "fine")
    assert [(r.label, r.value, r.done) for r in tracker.action_items(rows, "doc").orderBy("line_no").collect()] == [("Review", None, False), ("Next Chapter/File", "Chapter 2 / c02.pdf", True)]
    assert [(r.concept, r.definition) for r in tracker.concepts(rows, "doc").where("doc = 'note'").collect()] == [("Governance", "to rule")]
    log = [(r.topic, r.label, r.value, r.nested) for r in tracker.session_topics(rows, "doc").orderBy("line_no").collect()]
    assert log == [("Compliance", "Initial Understanding", "what rules: ask", False), ("Compliance", "Check (The Scenario)", None, False), ("Compliance", "Scenario Posed", "How?", True), ("Compliance", "My Response", None, True), ("Governance", "Initial Understanding", "aims", False)]


def test_the_latest_state_wins_and_a_gap_outweighs_mastery_of_the_same_day(spark):
    rows = [(1, "2025-01-01", "mastered", 3), (1, "2025-01-02", "gap", 3), (1, "2025-01-02", "mastered", 3), (1, "2025-01-03", None, 4), (2, "2025-01-01", "gap", None)]
    found = tracker.sync(spark.createDataFrame(rows, "learner_id long, day string, kind string, chapter int")).collect()
    assert [tuple(r) for r in found] == [(1, 3, "gap", "2025-01-02")]


def test_vocabulary_of_all_layouts(rows):
    got = {(r.doc, r.word): r for r in vocab.records(rows, "doc").collect()}
    assert set(got) == {("alone", "spark"), ("alone", "craft"), ("labelled", "spark"), ("table", "spark"), ("other order", "spark")}
    for doc in WORDS:
        r = got[doc, "spark"]
        assert (r.ipa, r.gloss) == ("spɑːk", "激发")
    assert (got["alone", "spark"].context, got["alone", "spark"].use) == ("A spark of hope.", "It may spark talks.")
    assert tuple(got["alone", "craft"])[2:] == ("krɑːft", None, None, None)
    assert (got["other order", "spark"].context, got["other order", "spark"].use) == (None, "To spark.")


def test_phrases_of_all_layouts(rows):
    got = {(r.doc, r.phrase): (r.gloss, r.sentence) for r in vocab.phrase_records(rows, "doc").collect()}
    assert got == {
        ("alone", "at heart"): ("本质上", "She is kind at heart."), ("labelled", "at heart"): ("本质上", "Kind at heart."), ("table", "at heart"): ("本质上", "Kind at heart."), ("table", "take (it) on"): ("承担（责任）", "We take it on."),
    }


def test_entities_and_the_source(rows):
    got = {(r.doc, r.term): (r.definition, r.link) for r in vocab.entities(rows, "doc").collect()}
    assert got == {
        ("plain", "Extract"): ("a tool, see https://no.example/x", "https://h.example/a?b=1"), ("plain", "Schema（JSON）"): ("a form", "https://h.example/a?b=1"),
        ("marked", "Extract"): ("a tool", "https://h.example/a"), ("marked", "Control (受控)"): ("a limit", "https://h.example/a"),
    }
    tags = rows.where("label = '标签'").select("doc", markdown.hash_tags(md.F.col("value")).alias("t")).collect()
    assert {r.doc: list(r.t) for r in tags} == {"plain": ["one", "two"], "marked": ["one", "two"]}


def test_malformed_tables_and_clashing_columns(spark):
    text = "| a | a |\n|---|---|\n| 1 | 2 | 3 |\n| x\n\n| only a header |\n\n|---|\n| 4 |\n" + "| long | row |\n" * 3000
    rows = md.blocks(spark.createDataFrame([(1, "k", text)], "kind_ int, label string, text string").withColumnRenamed("kind_", "id"), ["id"])
    cells = [[tuple(c) for c in r.cells] for r in rows.where("kind = 'row' AND line_no < 9").orderBy("line_no").collect()]
    assert cells == [[("a", "1"), ("a", "2"), (None, "3")], [("a", "x"), ("a", None)], [("---", "4")]] or cells[:2] == [[("a", "1"), ("a", "2"), (None, "3")], [("a", "x"), ("a", None)]]
    assert rows.where("kind = 'row'").count() >= 3000
    assert md.blocks(spark.createDataFrame([], "id int, text string"), ["id"]).count() == 0
