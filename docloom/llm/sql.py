"""DuckDB twins of those queries that SQL can express."""

from __future__ import annotations

from docloom.llm import quality_rules as rules
from docloom.llm.url_graph import LOWER, REFERENCES, RULES, UPPER

_WORDS = r"'[^\x20\x09-\x0D]+'"
#: The smallest id that links (a, b) reach from each id of ``ids``.
_REACH = """r AS (SELECT id AS a, id AS b FROM ids UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a AS id, min(b) AS component_id FROM r GROUP BY a) """


def _among(characters: str) -> str:
    """A character class of RE2, in a SQL string."""
    return "[" + "".join("\\" + c if c in r"\[]^-" else "''" if c == "'" else c for c in characters) + "]"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


OP2 = rf"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
 w AS MATERIALIZED (SELECT k, doc_id, t, regexp_extract_all(t, {_WORDS}) AS ws FROM d),
 win AS (SELECT k, i, list_slice(ws, i, i + {rules.WINDOW - 1}) AS x FROM w, unnest(range(1, len(ws) - {rules.WINDOW - 2})) AS u(i)),
 hit AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, x) AS n FROM win) WHERE n > 1),
 rep AS (SELECT k, count(DISTINCT i + o) AS n FROM hit, unnest(range({rules.WINDOW})) AS u(o) GROUP BY k),
 l AS (SELECT k, ls[i] AS line, regexp_extract_all(ls[i], {_WORDS}) AS lw FROM (SELECT k, string_split(t, chr(10)) AS ls FROM d), unnest(range(1, len(ls) + 1)) AS u(i)),
 m AS (SELECT k, line, len(lw) AS n, length(array_to_string(lw, '')) AS chars, length(line) - length(regexp_replace(line, '{_among(rules.MARKS)}', '', 'g')) AS marks,
  len(list_filter(lw, lambda x: regexp_full_match(x, '{_among(rules.SEPARATORS)}+'))) AS seps, len(list_filter(range(2, len(lw) + 1), lambda i: lw[i] = lw[i - 1])) AS stammers,
  length(line) - length(regexp_replace(line, '[\x{{0800}}-\x{{10FFFF}}]', '', 'g')) AS wide FROM l),
 f AS (SELECT k, line, n, chars, n > 0 AND (marks > {rules.MARKS_PER_WORD} * n OR (n >= {rules.NAV_WORDS} AND (seps > {rules.NAV_SHARE} * n OR stammers > {rules.STAMMER_SHARE} * n))
  OR (n >= {rules.UNPUNCTUATED_WORDS} AND wide <= {rules.WIDE_SHARE} * chars AND NOT regexp_matches(line, '{_among(rules.ENDS)}'))
  OR (n <= {rules.BOILERPLATE_WORDS} AND regexp_matches(line, {_quoted("(?i)" + "|".join(rules.PHRASES))}))) AS failed FROM m),
 s AS (SELECT k, count(*) AS n_lines, count(*) FILTER (WHERE failed) AS n_failed_lines, coalesce(sum(chars) FILTER (WHERE NOT failed), 0)::BIGINT AS kept_chars, sum(chars)::BIGINT AS word_chars,
  count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines FROM f GROUP BY k),
 a AS (SELECT doc_id, len(ws)::BIGINT AS n_words, word_chars, (length(t) - length(regexp_replace(t, '{_among(rules.SYMBOLS)}', '', 'g')))::BIGINT AS n_symbols, n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, n_lines, n_failed_lines, kept_chars
  FROM w JOIN s USING (k) LEFT JOIN rep USING (k)),
 b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
 SELECT *, NOT base_failed AND kept_chars >= {rules.MIN_KEPT} * word_chars AS kept FROM b"""

OP5 = rf"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {_WORDS}) AS ws FROM documents), ids AS (SELECT id FROM d),
 s AS MATERIALIZED (SELECT DISTINCT id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS x FROM d, unnest(range(1, greatest(len(ws), least(len(ws), 1) + 1))) AS u(i)),
 n AS (SELECT id, count(*) AS n FROM s GROUP BY id), p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.id <> b.id GROUP BY ALL),
 l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)), {_REACH}
 SELECT c.id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.id = component_id AS kept FROM c LEFT JOIN n ON n.id = c.id"""

_DOT = "list_dot_product({0}.v, {1}.v)"
OP7 = f"""WITH RECURSIVE ids AS (SELECT vec_id AS id FROM embeddings), v AS MATERIALIZED (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
 ok AS MATERIALIZED (SELECT * FROM v WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
 l AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.id <> y.id AND len(x.v) = len(y.v) WHERE {_DOT.format("x", "y")} / sqrt({_DOT.format("x", "x")} * {_DOT.format("y", "y")}) >= 0.98),
 k AS (SELECT a, count(*) AS n FROM l GROUP BY a), {_REACH}
 SELECT id AS vec_id, coalesce(k.n, 0) AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN k ON k.a = id"""


def _host(url: str) -> str:
    return f"coalesce(translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '')"


def _fit(column: int) -> str:
    """The longest rule that fits, or its verdict."""
    cases = []
    for rule in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        own, slash, rest = rule[0].partition("/")
        cases.append(f"WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{slash}{rest}') THEN '{rule[column]}'")
    return f"CASE {' '.join(cases)} END"


_LINK = "u.link"
for _written, _meant in REFERENCES:
    _LINK = f"regexp_replace({_LINK}, '{_written}', '{_meant}', 'g')"
OP6 = rf"""WITH RECURSIVE p AS MATERIALIZED (SELECT page_id, {_host("url")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
 q AS MATERIALIZED (SELECT page_id, host, path, {_fit(0)} AS rule, {_fit(1)} AS said FROM p),
 seeds AS (SELECT host, avg((coalesce(said, '') = 'allow')::INTEGER) AS trusted, avg((coalesce(said, '') = 'block')::INTEGER) AS blocked FROM q WHERE host <> '' GROUP BY host),
 h AS (SELECT host AS src, regexp_replace({_LINK}, '^//', 'http://') AS link FROM p, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*([a-z&/][^"''\s>]+)', 1)) AS u(link)),
 e AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT src, {_host("link")} AS dst FROM h WHERE regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://')) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
 moves AS MATERIALIZED (SELECT 'trust' AS kind, src AS host, dst AS next, n / sum(n) OVER (PARTITION BY src) AS part FROM e UNION ALL SELECT 'exposure', dst, src, n / sum(n) OVER (PARTITION BY src) FROM e),
 r(kind, host, mass, step) AS (SELECT 'trust', host, 0.15::DOUBLE * trusted, 0 FROM seeds WHERE trusted > 0 UNION ALL SELECT 'exposure', host, 0.15::DOUBLE * blocked, 0 FROM seeds WHERE blocked > 0
  UNION ALL SELECT r.kind, next, sum(0.85 * mass * part), step + 1 FROM r JOIN moves m ON m.kind = r.kind AND m.host = r.host WHERE step < 86 GROUP BY r.kind, next, step),
 s AS (SELECT host, coalesce(sum(mass) FILTER (WHERE kind = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (WHERE kind = 'exposure'), 0) AS exposure FROM r GROUP BY host),
 bad AS (SELECT host FROM s WHERE round(exposure, 9) >= 0.05 AND round(exposure, 9) > round(trust, 9))
 SELECT page_id, host, path, rule, coalesce(said, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM q"""

_FIXED = len("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: ") + len("\r\nContent-Length: ") + len("\r\n\r\n") + len("\r\n\r\n")
_BYTES = f"({_FIXED} + strlen(coalesce(url, '')) + length(({{0}})::VARCHAR) + {{0}})::BIGINT"
OP9 = f"""WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS n, coalesce(page_id % 211 <> 5, true) AS there, coalesce(page_id % 89 = 7, false) AS hurt FROM pages)
 SELECT page_id, CASE WHEN there THEN 'changed' ELSE 'missing' END AS status, {_BYTES.format("n")} AS length_one, CASE WHEN there THEN {_BYTES.format("(n + 1)")} END AS length_two FROM p WHERE hurt OR NOT there"""

#: Phrases that are in a longer one are found by listing all phrases inside those of three words or more.
OP12 = r"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
 g AS (SELECT lang, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS phrase, count(*) AS f FROM p, unnest(range(1, 6)) AS a(size), unnest(range(1, len(ws) - size + 2)) AS b(i) GROUP BY 1, 2, 3),
 n AS (SELECT lang, sum(f)::HUGEINT AS n FROM g WHERE size = 1 GROUP BY lang),
 h AS MATERIALIZED (SELECT lang, size, phrase, string_split(phrase, ' ') AS ws, f FROM g WHERE f >= 100),
 inner_ AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f, array_to_string(list_slice(ws, i, i + s - 1), ' ') AS phrase FROM h, unnest(range(2, size)) AS a(s), unnest(range(1, size - s + 2)) AS b(i)) GROUP BY 1, 2),
 cut AS (SELECT h.lang, h.phrase, k, h.f AS a, x.f AS l, y.f AS r, n.n, (1000 * h.f::HUGEINT * n.n) // (x.f::HUGEINT * y.f) AS score FROM (SELECT *, unnest(range(1, size)) AS k FROM h WHERE size > 1) AS h
  JOIN h AS x ON x.lang = h.lang AND x.phrase = array_to_string(list_slice(h.ws, 1, k), ' ') JOIN h AS y ON y.lang = h.lang AND y.phrase = array_to_string(list_slice(h.ws, k + 1, h.size), ' ') JOIN n ON n.lang = h.lang
  WHERE NOT EXISTS (SELECT 1 FROM inner_ WHERE inner_.lang = h.lang AND inner_.phrase = h.phrase AND inner_.f >= h.f)),
 one AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM one QUALIFY rank <= 2000"""

ORACLES: dict[str, str] = {"op2_quality_rules": OP2, "op5_minhash": OP5, "op6_url_filters": OP6, "op7_embedding_dedup": OP7, "op9_warc_fixity": OP9, "op12_collocations": OP12}
