"""Queries over study trackers, session notes and summaries in drifting layouts, rendered from tables and parsed back.

The corpora are SQL that Spark and DuckDB both run; the twins read the rendered texts with
regular expressions of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import blocks as md
from docloom.functions import markdown
from docloom.operators import lookups, tracker, vocab
from docloom.plans.support import Query, spread, table
from docloom.sources import io

_NL = "chr(10)"


def _joined(*parts: str) -> str:
    """SQL that concatenates parts: Python strings in quotes are text, others are expressions."""
    return f"concat({', '.join(parts)})"


def _text(value: str) -> str:
    return "concat(" + ", ".join(f"'{p}'" for p in value.replace("\n", "\x00chr(10)\x00").split("\x00") if p).replace("'chr(10)'", _NL) + ")"


def _trackers() -> str:
    """One Markdown tracker for each customer in one of three layouts; every tenth states wrong totals."""
    layouts: list[list[str]] = [
        [_text("| Domain & Chapters | Weight | Progress | Mastery | Status |\n| :--- | :----- | ---: | :---: | --- |\n")],
        [_text("| Status | Mastery | Chapter or Domain |\n|:--|---|---:|\n")],
        [_text("| Domain | Progress | Mastery | Weight | Notes | Status |\n")],
    ]
    for i, (lo, hi) in enumerate(tracker.CHAPTERS):
        n = hi - lo + 1
        done = {ch: f"(c_custkey * 7 + {ch}) % 3 = 0" for ch in range(lo, hi + 1)}
        count = "(" + " + ".join(f"CASE WHEN {d} THEN 1 ELSE 0 END" for d in done.values()) + ")"
        percent = f"CAST(floor(100.0 * {count} / {n}) AS INT) + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END"
        w = tracker.WEIGHTS[i]
        layouts[0].append(_joined(f"'| **D{i + 1}: Domain {i + 1}** | {w}% | '", count, f"'/{n} Ch. | '", percent, "'% | ⚪ Not Started |'", _NL))
        layouts[1].append(_joined("'| 🟠 | '", percent, f"'% | D{i + 1} |'", _NL))
        layouts[2].append(_joined(f"'| **D{i + 1}**: a '", "chr(92)", "'| b | '", count, f"'/{n} | '", percent, f"'% | {w}% | note | ⚪ |'", _NL))
        for ch, d in done.items():
            name = f"Ch {ch}: Topic {ch} (`ch{ch}.md`)"
            layouts[0].append(f"CASE WHEN {d} THEN " + _text(f"| - {name} |  | 1/1 Ch. | 100% | 🟢 Completed |\n") + " ELSE " + _text(f"| - {name} |  |  | [待填写] | ⚪ Not Started |\n") + " END")
            layouts[1].append(f"CASE WHEN {d} THEN " + _text(f"|🟢 Completed|[待填写]|{name}|\n") + " ELSE " + _text(f"|  |  | {name}\n") + " END")
            layouts[2].append(f"CASE WHEN {d} THEN " + _text(f"| - {name} | 1/1 | 100% | | | ✅ |\n") + " ELSE " + _text(f"| - {name} |\n") + " END")
    tables = [f"concat({', '.join(parts)})" for parts in layouts]
    return f"SELECT c_custkey AS learner_id, concat('# Tracker', {_NL}, 'Current Overall Progress: ', c_custkey % 101, '%', {_NL}, {_NL}, '## 1. Overview', {_NL}, {_NL}, CASE c_custkey % 3 WHEN 0 THEN {tables[0]} WHEN 1 THEN {tables[1]} ELSE {tables[2]} END, {_NL}, '## 2. 🚩 Gaps', {_NL}, '*None yet.*', {_NL}) AS text FROM {{customer}}"


def _by_layout(key: str, *ways: str) -> str:
    return f"CASE {key} % 3 WHEN 0 THEN {ways[0]} WHEN 1 THEN {ways[1]} ELSE {ways[2]} END"


def _heading(key: str, number: int, title: str, level: int = 2) -> str:
    return _by_layout(key, _text(f"\n{'#' * level} {number}. {title}\n"), _text(f"\n\n{number}. {title}\n\n"), _text(f"\n{'#' * level} 🚩 {title}\n"))


def _item(key: str, label: str, value: str, indent: str = "") -> str:
    return _joined(_by_layout(key, f"'{indent}- **{label}**: '", f"'{indent}* **{label}:** '", f"'{indent}- {label}: '"), value, _NL)


def _sessions() -> str:
    """One note for each order: learner and day, a logged topic, up to two gaps, up to one mastered topic, action items."""
    k = "o_orderkey"
    gap = lambda j: f"concat('| ', CASE WHEN {k} % 7 = {j} THEN '[待填写]' ELSE 'topic {j}' END, ' | Ch. ', ({k} * {j}) % 21 + 1, ' | High | |', {_NL})"
    parts = [
        "'# Session Notes: '", k, _NL, _heading(k, 1, "Session Overview"),
        _item(k, "Date", "substr(CAST(o_orderdate AS STRING), 1, 10)"), _item(k, "Learner", "o_custkey"), _item(k, "Duration", "'[Approximate time]'"),
        _item(k, "OSG Chapter(s)", f"CASE WHEN {k} % 5 = 0 THEN '[e.g., Chapter 1]' ELSE concat('Chapter ', {k} % 21 + 1) END"),
        _heading(k, 2, "Interactive Learning Log"), _text("#### Topic 1: Basics\n"), _item(k, "Initial Understanding", "o_orderpriority"), _item(k, "Check", "''"),
        _item(k, "My Response", f"CASE WHEN {k} % 4 = 0 THEN '[待填写]' ELSE concat('answer ', {k}) END", "    "),
        _heading(k, 3, "Knowledge Gaps Identified (to be synced)"), _text("| Topic | OSG Chapter | Severity | Notes |\n| :--- | :--- | :--- | :--- |\n"),
        f"CASE WHEN {k} % 3 > 0 THEN {gap(1)} ELSE '' END", f"CASE WHEN {k} % 3 > 1 THEN {gap(2)} ELSE '' END",
        _heading(k, 4, "Topics Mastered Today"), _by_layout(k, _text("| Topic | Confidence | Notes |\n|---|---|---|\n"), _text("| Topic | Confidence | Notes |\n|---|---|---|\n"), _text("| Chapter | Confidence | Topic |\n|---|---|---|\n")),
        f"CASE WHEN {k} % 2 = 0 THEN " + _by_layout(k, _text("| done | High | ok |\n"), _text("| done | Low | ok |\n"), f"concat('| Ch ', {k} % 20 + 1, ' | High | done |', {_NL})") + " ELSE '' END",
        _heading(k, 5, "Action Items"), _text("- [x] **Review**: everything\n- [ ] **Practice**: [Specific scenario]\n"),
    ]
    return f"SELECT {k} AS session_id, concat({', '.join(parts)}) AS text FROM {{orders}}"


def _summaries() -> str:
    """One summary for each document: tags, all lines as numbered points, entities and the source."""
    k = "doc_id"
    tags = _by_layout(k, "'标签：'", "'**标签：** '", "'Tags: '")
    source = _by_layout(k, f"concat('✅ 原始资料来源：https://h/', {k})", f"concat('✅ **原始资料来源：** [h](https://h/', {k}, ')')", f"concat('Link: https://h/', {k})")
    return f"SELECT {k}, concat('# Summary', {_NL}, {tags}, '#', lang, ' #', source, {_NL}, {_heading(k, 1, 'Points')}, '1.1 ', replace(text, {_NL}, concat({_NL}, '1.1 ')), {_NL}, {_heading(k, 2, 'Key Entities')}, {_item(k, 'lang', 'lang')}, {_item(k, 'source', 'source')}, {_NL}, {source}, {_NL}) AS text FROM {{documents}}"


TRACKERS, SESSIONS, SUMMARIES = _trackers(), _sessions(), _summaries()


def tracker_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRACKERS, customer=spread(table(spark, sf_dir, "customer"), "c_custkey"))


def session_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SESSIONS, orders=spread(table(spark, sf_dir, "orders"), "o_orderkey"))


def summary_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SUMMARIES, documents=spread(table(spark, sf_dir, "documents"), "doc_id"))


def _tracker_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.blocks(tracker_corpus(spark, sf_dir), ["learner_id"])


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.typed_rows(md.listed(tracker_corpus(spark, sf_dir), ["learner_id"]), "learner_id")


def trk1_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tracker_blocks(spark, sf_dir).where("kind = 'row'")
    return rows.groupBy("learner_id").agg(F.count("*").alias("n_rows"), F.sum(F.size("cells")).alias("n_cells"), F.count(F.when(F.exists("cells", lambda c: c["value"].rlike("^D[0-9]")), 1)).alias("n_domains"))


def trk2_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).select("learner_id", "domain", "chapter", "file", "weight", "finished", "parts", "stated", "status", "done")


def trk3_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished and all chapters at each level: chapter, domain, whole tracker."""
    return tracker.rollup(_typed(spark, sf_dir), "learner_id").select("learner_id", "domain", "chapter", F.col("done").cast("long").alias("done"), "chapters")


def trk4_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.weighted(_typed(spark, sf_dir), "learner_id", tracker.domains(spark))


def trk5_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a tracker states another percentage than its chapters give: domains, and the whole by weight (domain null)."""
    listed = md.listed(tracker_corpus(spark, sf_dir), ["learner_id"])
    rows = io.stored(listed.select("learner_id", F.filter("blocks", lambda b: (b["kind"] == "row") | b["label"].isNotNull()).alias("blocks")), "trackers")
    typed = io.stored(tracker.typed_rows(rows, "learner_id"), "typed")
    parts = tracker.inconsistent(typed, "learner_id").where("difference <> 0").select("learner_id", "domain", "stated", F.col("derived").cast("double").alias("derived"))
    whole = tracker.stated_overall(rows, "learner_id").join(tracker.weighted(typed, "learner_id", tracker.domains(spark)), "learner_id").where("stated <> progress")
    return parts.unionByName(whole.select("learner_id", F.lit(None).cast("string").alias("domain"), "stated", F.col("progress").alias("derived")))


def _session_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.listed(session_corpus(spark, sf_dir), ["session_id"])


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.session_findings(_session_blocks(spark, sf_dir))


def trk6_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = lookups.in_range(_findings(spark, sf_dir).where("kind = 'gap'"), tracker.domains(spark), F.col("chapter"))
    return gaps.select("domain", tracker.severity(F.col("domain")).alias("severity")).groupBy("domain", "severity").agg(F.count("*").alias("gaps"))


def trk7_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each note: its head, findings, answered statements of its log and open action items."""
    blocks, some = F.col("blocks"), lambda c, fits: F.size(F.filter(c, fits)).cast("long")
    logged, actions = F.filter(blocks, tracker.is_topic), F.filter(blocks, tracker.is_action)
    rows = tracker.with_heads(_session_blocks(spark, sf_dir), "session_id", found=tracker.findings_of(blocks), logged=F.transform(logged, lambda b: b["value"]), actions=F.transform(actions, lambda b: F.struct(b["checked"].alias("done"), b["value"].alias("value"))))
    kind = lambda k: some("found", lambda f: f["kind"] == k).alias(k)
    return rows.select(
        "session_id", "head.learner_id", "head.day", "head.duration", "head.chapter", kind("gap"), kind("mastered"), some("found", lambda f: f["topic"].isNotNull()).alias("named"),
        F.size("logged").cast("long").alias("statements"), some("logged", lambda v: v.isNotNull()).alias("answered"), some("actions", lambda a: ~a["done"]).alias("open"), some("actions", lambda a: a["value"].isNotNull()).alias("planned"),
    )


def trk8_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.sync(_findings(spark, sf_dir))


def src6_files(spark: SparkSession, sf_dir: str, file_notes: int = 500) -> DataFrame:
    """The session notes written to Markdown files of about ``file_notes`` notes, read back whole, split and parsed."""
    notes, path = session_corpus(spark, sf_dir), io.work_path(spark, "sessions")
    buckets = notes.count() // file_notes + 1
    notes.select(F.pmod(F.xxhash64("session_id"), F.lit(buckets)).alias("bucket"), F.col("text").alias("value")).repartition("bucket").write.partitionBy("bucket").text(path)
    # a file holds one note after the other; each begins with its heading
    each = io.read_texts(spark, path).select(F.explode(F.filter(F.split("text", r"(?m)^(?=# Session Notes)"), lambda t: t.rlike(r"\S"))).alias("text"))
    rows = tracker.session_findings(md.listed(each.select(F.xxhash64("text").alias("session_id"), "text"), ["session_id"]))
    kind = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(k)
    return rows.groupBy("learner_id", "day").agg(kind("gap"), kind("mastered"))


def _summary_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.blocks(summary_corpus(spark, sf_dir), ["doc_id"])


def not1_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each section; the three styles of headings give the same titles."""
    rows = _summary_blocks(spark, sf_dir).where("kind <> 'heading'").withColumn("section", F.element_at("path", -1)).where("section <> 'Summary'")
    return rows.groupBy("doc_id", "section").agg(F.count("*").alias("lines"))


def not2_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _summary_blocks(spark, sf_dir).where(F.col("label").rlike("^(标签|Tags)$"))
    return rows.select("doc_id", F.array_join(markdown.hash_tags(F.col("value")), ",").alias("tags"))


def not3_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markdown.points(F.col("text"))
    return summary_corpus(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("n_points"), F.array_join(found, "\n").alias("points"))


def not4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.entities(md.listed(summary_corpus(spark, sf_dir), ["doc_id"]))


QUERIES: dict[str, Query] = {f.__name__: f for f in (src6_files, trk1_table, trk2_typed, trk3_rollup, trk4_weighted, trk5_check, trk6_severity, trk7_sessions, trk8_sync, not1_sections, not2_tags, not3_points, not4_entities)}

# --- twins: rows of tables with their header and the heading above, read from the rendered text


def _table(corpus: str, key: str) -> str:
    return rf"""WITH corpus AS ({corpus}), l AS (SELECT {key}, ls, i FROM (SELECT {key}, string_split(text, chr(10)) AS ls FROM corpus), unnest(range(1, len(ls) + 1)) AS u(i)),
 s AS (SELECT {key}, i, ls[i] AS line, coalesce(i > 1 AND ls[i - 1] LIKE '|%', false) AS follows,
  last_value(CASE WHEN regexp_matches(ls[i], '^#|^[0-9]+[.] ') THEN ls[i] END IGNORE NULLS) OVER w AS heading FROM l WINDOW w AS (PARTITION BY {key} ORDER BY i)),
 c AS (SELECT {key}, i, follows, heading, list_transform(string_split(regexp_replace(replace(line, '\|', chr(1)), '^\||\|$', '', 'g'), '|'), lambda x: trim(replace(replace(x, chr(1), '|'), '**', ''))) AS cs FROM s WHERE line LIKE '|%' AND NOT regexp_matches(line, '^\|([ :]*-+[ :]*\|)+$')),
 h AS (SELECT *, last_value(CASE WHEN NOT follows THEN cs END IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY i) AS names FROM c),
 b AS (SELECT * FROM h WHERE follows) """


def _cell(name: str) -> str:
    value = f"cs[list_position(list_transform(names, lambda n: regexp_matches(n, '(?i){name}')), true)]"
    return f"nullif(nullif({value}, ''), '[待填写]')"


_VALUES = ", ".join(f"('D{i + 1}', {w}, {lo}, {hi})" for i, (w, (lo, hi)) in enumerate(zip(tracker.WEIGHTS, tracker.CHAPTERS, strict=True)))
_DM = f"dm AS (SELECT * FROM (VALUES {_VALUES}) v(domain, weight, lo, hi))"
_T = _table(TRACKERS.format(customer="customer"), "learner_id") + (
    f", n AS (SELECT learner_id, i, {_cell('domain|chapter')} AS name, {_cell('weight')} AS weight, {_cell('progress')} AS progress, {_cell('mastery')} AS mastery, {_cell('status')} AS status FROM b),"
    " t AS (SELECT learner_id, last_value(nullif(regexp_extract(name, '^(D[0-9]+)', 1), '') IGNORE NULLS) OVER (PARTITION BY learner_id ORDER BY i) AS domain, try_cast(regexp_extract(name, 'Ch ([0-9]+)', 1) AS INTEGER) AS chapter, nullif(regexp_extract(name, '`([^`]*)`', 1), '') AS file,"
    " try_cast(regexp_extract(weight, '([0-9]+)%', 1) AS INTEGER) AS weight, try_cast(regexp_extract(progress, '([0-9]+)/', 1) AS INTEGER) AS finished, try_cast(regexp_extract(progress, '/([0-9]+)', 1) AS INTEGER) AS parts, try_cast(regexp_extract(mastery, '([0-9]+)%', 1) AS INTEGER) AS stated, status, coalesce(regexp_matches(status, 'Completed|✅'), false) AS done FROM n)"
    f", {_DM}, p AS (SELECT learner_id, domain, avg(done::INTEGER) AS share FROM t WHERE chapter IS NOT NULL GROUP BY ALL), q AS (SELECT learner_id, round(sum(weight * share), 4) AS progress FROM p JOIN dm USING (domain) GROUP BY learner_id)"
)


def _field(label: str) -> str:
    return rf"nullif(trim(regexp_extract(text, '(?m)^ *[-*] (?:\*\*)?{label}(?:\*\*:|:\*\*|:) *([^\n]*)$', 1)), '')"


_S = _table(SESSIONS.format(orders="orders"), "session_id") + (
    f", {_DM}, head AS (SELECT session_id, {_field('Learner')}::BIGINT AS learner_id, {_field('Date')} AS day, try_cast(regexp_extract({_field('OSG Chapter[(]s[)]')}, '^Chapter ([0-9]+)', 1) AS INTEGER) AS chapter, text FROM corpus),"
    f" f AS (SELECT session_id, learner_id, day, CASE WHEN heading LIKE '%Gaps Identified%' THEN 'gap' ELSE 'mastered' END AS kind, {_cell('topic')} AS topic, coalesce(try_cast(regexp_extract({_cell('chapter')}, '([0-9]+)', 1) AS INTEGER), chapter) AS chapter FROM b JOIN head USING (session_id))"
)
_DOCS = f"WITH corpus AS ({SUMMARIES.format(documents='documents')}) "
ORACLES = {
    "src6_files": _S + "SELECT learner_id, day, count(*) FILTER (WHERE kind = 'gap') AS gap, count(*) FILTER (WHERE kind = 'mastered') AS mastered FROM f GROUP BY ALL",
    "trk1_table": _T + "SELECT learner_id, count(*) AS n_rows, sum(greatest(len(cs), len(names)))::BIGINT AS n_cells, count(*) FILTER (WHERE len(list_filter(cs, lambda x: regexp_matches(x, '^D[0-9]'))) > 0) AS n_domains FROM b GROUP BY learner_id",
    "trk2_typed": _T + "SELECT * FROM t",
    "trk3_rollup": _T + "SELECT learner_id, domain, chapter, sum(done::INTEGER)::BIGINT AS done, count(*) AS chapters FROM t WHERE chapter IS NOT NULL GROUP BY GROUPING SETS ((learner_id, domain, chapter), (learner_id, domain), (learner_id))",
    "trk4_weighted": _T + "SELECT learner_id, progress FROM q",
    "trk5_check": _T + ", d AS (SELECT learner_id, domain, floor(100 * share + 1e-9) AS derived FROM p) SELECT learner_id, domain, stated, derived FROM t JOIN d USING (learner_id, domain) WHERE chapter IS NULL AND stated <> derived UNION ALL SELECT learner_id, NULL, stated, progress FROM q JOIN (SELECT learner_id, regexp_extract(text, 'Progress: ([0-9]+)%', 1)::INTEGER AS stated FROM corpus) USING (learner_id) WHERE stated <> progress",
    "trk6_severity": _S + "SELECT domain, CASE WHEN domain IN ('D1', 'D3', 'D4', 'D7') THEN 'High' ELSE 'Normal' END AS severity, count(*) AS gaps FROM f JOIN dm ON chapter BETWEEN lo AND hi WHERE kind = 'gap' GROUP BY ALL",
    "trk7_sessions": _S + r""", g AS (SELECT session_id, count(*) FILTER (WHERE kind = 'gap') AS gap, count(*) FILTER (WHERE kind = 'mastered') AS mastered, count(topic) AS named FROM f GROUP BY session_id)
 SELECT session_id, learner_id, day, NULL::VARCHAR AS duration, chapter, coalesce(gap, 0) AS gap, coalesce(mastered, 0) AS mastered, coalesce(named, 0) AS named, 3::BIGINT AS statements, len(regexp_extract_all(text, '(?m)(Initial Understanding|My Response)[:*]+ +[^ \[]'))::BIGINT AS answered, len(regexp_extract_all(text, '\[ \]'))::BIGINT AS open, len(regexp_extract_all(text, '(?m)^- \[.\] \*\*[A-Za-z]+\*\*: [^\[]'))::BIGINT AS planned FROM head LEFT JOIN g USING (session_id)""",
    "trk8_sync": _S + "SELECT learner_id, chapter, arg_max(kind, day || (kind = 'gap')::INTEGER) AS state, max(day) AS day FROM f WHERE chapter IS NOT NULL GROUP BY ALL",
    "not1_sections": _DOCS + "SELECT doc_id, 'Key Entities' AS section, 3::BIGINT AS lines FROM corpus UNION ALL SELECT doc_id, 'Points', len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '1.1'))) FROM corpus",
    "not2_tags": _DOCS + "SELECT doc_id, array_to_string(list_transform(regexp_extract_all(string_split(text, chr(10))[2], '#[^\\s#]+'), lambda x: x[2:]), ',') AS tags FROM corpus",
    "not3_points": "SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_points, text AS points FROM documents",
    "not4_entities": _DOCS + "SELECT doc_id, term, CASE term WHEN 'lang' THEN lang ELSE source END AS definition, regexp_extract(c.text, '(https://h/[0-9]+)', 1) AS link FROM corpus c JOIN documents d USING (doc_id), (VALUES ('lang'), ('source')) v(term)",
}
