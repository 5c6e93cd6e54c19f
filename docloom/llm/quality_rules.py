"""Line-first quality rules.

Every line of a text is judged by itself (punctuation, navigation, boilerplate);
failing lines are removed; a document that loses too much of its text is rejected.
Counts over whole documents come from byte arithmetic on Arrow buffers: no Python
loop runs over words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACE, mix, range_hashes, slices, utf8, words_of

#: Words in a window of the repetition measure.
WINDOW = 8
#: A line fails the punctuation rule above this share of symbols, or of exclamation marks, a word,
MARKS_PER_WORD = 0.5
#: and from so many words on if nothing in it ends a sentence or a clause; scripts that write none are exempt.
UNPUNCTUATED_WORDS, WIDE_SHARE = 30, 0.3
#: A line of at least this many words fails the navigation rule above this share of separators among its words,
NAV_WORDS, NAV_SHARE = 4, 0.25
#: and the boilerplate rule if more than this share of its words repeat the word before.
STAMMER_SHARE = 0.5
#: Below this share of kept word characters a document is rejected.
MIN_KEPT = 0.5
# Phrases of boilerplate lines (short notices of rights, consent and navigation) by language.
PHRASES = (
    "all rights reserved|licen[sc]ed under|released under the|this work is licensed|terms of (use|service)|privacy policy|"
    "cookie (policy|settings)|accept (all )?cookies|uses? cookies|subscribe to our|sign up for our|click here|skip to (main )?content|"
    "javascript is (disabled|required)|back to top|share (this|on)",
    "alle rechte vorbehalten|lizenziert unter|datenschutzerklärung|nutzungsbedingungen|cookie-einstellungen|cookies akzeptieren|verwendet cookies|newsletter abonnieren|hier klicken|zum inhalt springen|nach oben",
    "tous droits réservés|sous licence|mentions légales|politique de confidentialité|conditions d'utilisation|accepter (tous )?les cookies|utilise des cookies|abonnez-vous à notre|cliquez ici|aller au contenu|retour en haut",
    "todos los derechos reservados|bajo (la )?licencia|aviso legal|política de privacidad|condiciones de uso|aceptar (todas )?las cookies|utiliza cookies|suscríbase a nuestr[oa]|haga clic aquí|saltar al contenido|volver arriba",
)
BOILERPLATE = re.compile("|".join(PHRASES), re.IGNORECASE)
#: Boilerplate lines are short: a long paragraph that quotes such a phrase stays.
BOILERPLATE_WORDS = 30
# Symbols, marks, separators between links, and what ends a sentence or a clause in any script.
SYMBOLS, MARKS, SEPARATORS, ENDS = "#*$%&|<>", "#*$%&<>!^~_=+{}[]\\@", "|/>•·»›→–—", ".!?,;:…。！？、，；：।؟،։።။។"
_SEPARATOR_WORD = re.compile(rb"(?:" + b"|".join(re.escape(c.encode()) for c in SEPARATORS) + rb")+")
_END = re.compile("|".join(re.escape(c) for c in ENDS).encode())


def _set_of(characters: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[[ord(c) for c in characters]] = True
    return found


_SYMBOL, _MARK = _set_of(SYMBOLS), _set_of(MARKS)
#: First bytes of separators, and of characters that take three bytes or more.
_SEPARATOR_BYTE = np.zeros(256, bool)
_SEPARATOR_BYTE[[c.encode()[0] for c in SEPARATORS]] = True
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_failed_lines long, kept_chars long, base_failed boolean, kept boolean"


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def _repeated(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """True where a value occurs at least twice for its owner."""
    key = values ^ mix(owner.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    order = np.argsort(key)
    ranked = key[order]
    same = np.zeros(len(key), bool)
    if len(key) > 1:
        eq = ranked[1:] == ranked[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.zeros(len(key), bool)
    out[order] = same
    return out


def _later(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """True where a value occurred before for its owner."""
    key = values ^ mix(owner.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    out = np.zeros(len(key), bool)
    if len(key) > 1:
        out[order[1:]] = ranked[1:] == ranked[:-1]
    return out


def measure(texts: pa.Array) -> tuple[dict[str, np.ndarray], list[np.ndarray], np.ndarray]:
    """All measures of each text, for each text whether each of its lines stays, and whether the line rules let it pass."""
    data, off = utf8(texts)
    n = len(off) - 1
    starts, ends, first, last = words_of(data, off)
    n_words = last - first
    rise = (data & 0xC0) != 0x80
    word_byte = ~SPACE[data] & rise
    word_chars = _sums(word_byte, off[:-1], off[1:])
    n_symbols = _sums(_SYMBOL[data], off[:-1], off[1:])

    doc_of_word = np.repeat(np.arange(n), n_words)
    hashes = range_hashes(data, starts, ends)
    n_repeat = np.zeros(n, np.int64)
    m = len(hashes) - WINDOW + 1
    if m > 0:
        rolled = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + m]
        whole = doc_of_word[:m] == doc_of_word[WINDOW - 1 :]
        at = np.flatnonzero(whole)
        hit = at[_repeated(doc_of_word[at], mix(rolled[at]))]
        change = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(change, hit, 1)
        np.add.at(change, hit + WINDOW, -1)
        n_repeat = np.bincount(doc_of_word[np.cumsum(change[:-1]) > 0], minlength=n).astype(np.int64)

    # lines: the pieces between \n, which may be empty
    breaks = np.flatnonzero(data == 10)
    cuts = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    doc_of_line = np.repeat(np.arange(n), np.diff(np.searchsorted(breaks, off)) + 1)
    line_end = np.sort(np.concatenate([off[1:], breaks]), kind="stable")
    line_words = np.searchsorted(starts, line_end) - np.searchsorted(starts, cuts)
    worded = np.flatnonzero(line_words > 0)
    line_hash = range_hashes(data, cuts[worded], line_end[worded])
    n_dup = np.bincount(doc_of_line[worded][_later(doc_of_line[worded], line_hash)], minlength=n).astype(np.int64)

    chars = _sums(word_byte, cuts, line_end)
    marks = _sums(_MARK[data], cuts, line_end)
    raw = data.tobytes()
    separator = np.zeros(len(starts) + 1, np.int64)
    for w in np.flatnonzero(_SEPARATOR_BYTE[data[starts]]) if len(starts) else ():
        separator[w + 1] = _SEPARATOR_WORD.fullmatch(raw, starts[w], ends[w]) is not None
    again = np.zeros(len(starts) + 1, np.int64)
    if len(starts) > 1:
        again[2:] = hashes[1:] == hashes[:-1]
    begin, stop = np.searchsorted(starts, cuts), np.searchsorted(starts, line_end)
    again[begin[line_words > 0] + 1] = 0  # the first word of a line repeats nothing in it
    separators, stammers = (np.cumsum(x)[stop] - np.cumsum(x)[begin] for x in (separator, again))
    wide = _sums(data >= 0xE0, cuts, line_end)
    long = line_words >= NAV_WORDS
    failed = (marks > MARKS_PER_WORD * line_words) | (long & (separators > NAV_SHARE * line_words)) | (long & (stammers > STAMMER_SHARE * line_words))
    for i in np.flatnonzero((line_words >= UNPUNCTUATED_WORDS) & ~failed & (wide <= WIDE_SHARE * chars)):
        failed[i] = _END.search(raw, cuts[i], line_end[i]) is None
    for i in np.flatnonzero((line_words > 0) & (line_words <= BOILERPLATE_WORDS) & ~failed):
        if BOILERPLATE.search(raw[cuts[i] : line_end[i]].decode("utf-8", "replace")):
            failed[i] = True
    failed &= line_words > 0
    kept_chars = np.bincount(doc_of_line[~failed], weights=chars[~failed], minlength=n).astype(np.int64)
    n_lines = np.bincount(doc_of_line, minlength=n).astype(np.int64)
    base_failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
    passed = kept_chars >= MIN_KEPT * word_chars
    kept = ~base_failed & passed
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "n_lines": n_lines, "n_failed_lines": np.bincount(doc_of_line[failed], minlength=n).astype(np.int64), "kept_chars": kept_chars, "base_failed": base_failed, "kept": kept}
    # what a filter needs: the line rules alone, as a short document is no worse for that
    passed &= n_words > 0
    bounds = np.concatenate([[0], np.cumsum(n_lines)])
    stays = [~failed[bounds[i] : bounds[i + 1]] for i in range(n)]
    return out, stays, passed


def judge(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id`` and the measures and verdicts.

    Null and empty texts have no word, fail the base rules and are not kept; a
    text without failing lines loses nothing.  Ids may be null or repeated, each row is
    judged by itself; an empty table gives no row, and other columns are not looked at.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", rows=1024):
            got, _, _ = measure(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(v) for v in got.values()]], names=["doc_id", *got])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(apply, f"doc_id long, {MEASURES}")


def clean(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass the line rules, with failing lines removed from ``text`` (and ``n_chars`` counted anew).

    A document goes if it keeps less than MIN_KEPT of its word characters or has no words
    (null, empty or blank); the base measures of ``judge`` decide nothing here, so a short or
    a repetitive document of good lines stays.  All other columns keep their values, whatever their names; rows with a null or
    repeated id are judged each by its own text, and an empty table stays empty.
    """
    names = docs.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", rows=1024):
            got, stays, passed = measure(b.column(names.index("text")))
            texts = b.column(names.index("text")).to_pylist()
            for i in np.flatnonzero(passed & (got["n_failed_lines"] > 0)):
                texts[i] = "\n".join(line for line, stay in zip(texts[i].split("\n"), stays[i], strict=True) if stay)
            columns = list(b.columns)
            columns[names.index("text")] = pa.array(texts, b.schema.field("text").type)
            if "n_chars" in names:
                given = columns[names.index("n_chars")].to_pylist()
                counts = [len(x) if got["n_failed_lines"][i] > 0 and x is not None else given[i] for i, x in enumerate(texts)]
                columns[names.index("n_chars")] = pa.array(counts, b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema).filter(pa.array(passed))

    return docs.mapInArrow(apply, docs.schema)
