"""The lines of Arrow batches of Markdown texts as typed blocks, for ``blocks``.

Documents stay whole in their batch, so what a line takes from lines above it (headings, table
header, parent item) is a running maximum over positions and needs neither shuffle nor sort.
Equal lines of a batch are looked at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docloom.functions.text import WHITE

LEVELS = 6
#: Bytes of text, and 16 for each line, that are parsed at a time; a longer document is parsed by itself.
PIECE = 1 << 24
#: Up to so many digits, and blanks before and behind, the number of an item is told apart from its line.
SHORT = 16
KINDS = ("blank", "heading", "row", "rule", "point", "item", "quote", "text")
BLANK, HEADING, ROW, RULE, POINT, ITEM, QUOTE, TEXT = range(8)
# White space, other characters and a rest of line as the patterns of Spark's functions mean them.
_S, _N, _DOT = r"[\t-\r ]", r"[^\t-\r ]", r"[^\n\r\x{85}\x{2028}\x{2029}]"
#: A symbol such as an emoji, with its variation mark.
_SYMBOL = r"[\p{So}\p{Sk}\x{FE0F}\x{200D}]+"
_COLON = "[:：]"
_KEY = r"[^\t-\r *|`\[(（<][^*|:：]{0,60}?"
_KEY_VALUE = rf"^{_KEY}{_S}*{_COLON}{_S}*({_N}{_DOT}*)?$"
# A key has no colon behind its first character, so its line is cut there; captures behind a counted repetition would be slow.
_AT_COLON = rf"(?s)^(?P<a>.[^:：]*){_COLON}(?P<b>.*)$"

FIELDS = pa.list_(pa.struct([("line_no", pa.int32()), ("label", pa.string()), ("value", pa.string()), ("content", pa.string())]))
BLOCK = [
    ("line_no", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("number", pa.string()), ("content", pa.string()), ("checked", pa.bool_()), ("label", pa.string()), ("value", pa.string()),
    ("ipa", pa.string()), ("aside", pa.string()), ("table_no", pa.int64()), ("cells", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("path", pa.list_(pa.string())), ("parent", pa.int32()), ("fields", FIELDS),
]
#: Columns of ``blocks.parts`` before the parts.
PARTS = ("kind", "label", "value", "ipa", "aside")
BLOCK_SQL = (
    "line_no int, kind string, level int, number string, content string, checked boolean, label string, value string, ipa string, aside string, table_no bigint, "
    "cells array<struct<name:string,value:string>>, path array<string>, parent int, fields array<struct<line_no:int,label:string,value:string,content:string>>"
)


def _np(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def _flags(values: pa.Array) -> np.ndarray:
    return _np(pc.fill_null(values, False)).astype(bool)


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets of strings, and the bytes that they point into."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1] if offsets and offsets.size else np.zeros(1, np.int32)
    return at, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def _first(values: pa.Array) -> np.ndarray:
    """The first byte of each string, 0 if it has none."""
    at, data = _bytes(values)
    out, some = np.zeros(len(values), np.uint8), at[1:] > at[:-1]
    out[some] = data[at[:-1][some]]
    return out


def _fits(values: pa.Array, pattern: str, among: np.ndarray) -> np.ndarray:
    """Which of the values ``among`` has flagged match."""
    out, at = np.zeros(len(values), bool), np.flatnonzero(among)
    if len(at):
        out[at] = _flags(pc.match_substring_regex(values.take(pa.array(at)), pattern))
    return out


def _some(values: pa.Array, among: np.ndarray, make: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``make`` of the flagged values, the others as they are."""
    if among.all():
        return make(values)
    return pc.replace_with_mask(values, pa.array(among), make(values.filter(pa.array(among)))) if among.any() else values


def _group(values: pa.Array, pattern: str, among: np.ndarray, name: str = "a") -> pa.Array:
    """What a named group matched in the flagged values; null if the pattern did not, or the group matched nothing."""
    return _some(pa.nulls(len(values), pa.string()), among, lambda _: _full(pc.struct_field(pc.extract_regex(values.filter(pa.array(among)), pattern), name)))


def _full(values: pa.Array) -> pa.Array:
    return pc.if_else(pc.equal(values, ""), pa.scalar(None, pa.string()), values)


def _drop(values: pa.Array, pattern: str) -> pa.Array:
    return pc.replace_substring_regex(values, pattern, "")


def _plain(values: pa.Array) -> pa.Array:
    bare = _some(values, _flags(pc.match_substring(values, "**")), lambda v: pc.replace_substring_regex(v, rf"\*\*({_DOT}*?)\*\*", r"\1"))
    return pc.utf8_trim(bare, characters=WHITE)


def _filled(values: pa.Array) -> pa.Array:
    return pc.if_else(pa.array(_fits(values, r"^(\[[^\]]*\])?$", _flags(pc.or_(pc.equal(values, ""), pc.starts_with(values, "["))))), pa.scalar(None, pa.string()), values)


def _lists(counts: np.ndarray, values: pa.Array, absent: np.ndarray | None = None) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=None if absent is None else pa.array(absent))


def _runs(counts: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each count n, one run after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _distinct(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes (below ``n``) that occur, in order, and the place of each one among them."""
    used = np.zeros(n, bool)
    used[codes] = True
    return np.flatnonzero(used), (np.cumsum(used) - 1)[codes]


def _pair(bare: pa.Array) -> dict[str, pa.Array]:
    """Label, value, ipa and aside of lines: a key and its value, or a bold term and what follows it."""
    bold, null = _flags(pc.starts_with(bare, "**")), pa.nulls(1, pa.string())
    # a bold term, as which many lines begin, is looked at once; its colon may stand within, or first behind it
    parts = pc.split_pattern(bare.filter(pa.array(bold)), "**", max_splits=2)
    three = _np(pc.equal(pc.list_value_length(parts), 3)).astype(bool)
    at, flat, begin = np.flatnonzero(bold)[three], parts.flatten(), _np(parts.offsets)[:-1][three] - _np(parts.offsets)[0]
    coded, rest = flat.take(pa.array(begin + 1)).dictionary_encode(), flat.take(pa.array(begin + 2))
    terms, code = coded.dictionary, _np(coded.indices)
    key = pc.struct_field(pc.extract_regex(terms, rf"^(?P<a>[^*]+?){_S}*{_COLON}{_S}*$"), "a")
    named, keyed = _flags(pc.match_substring_regex(terms, r"^[^*]+$"))[code], _flags(key.is_valid())[code]
    even = _fits(rest, rf"^{_S}*{_DOT}*$", named)
    within = keyed & even
    behind = _fits(rest, rf"^{_S}*{_COLON}{_S}*{_DOT}*$", named & ~within)
    said = named & ~within & ~behind
    more = _fits(rest, rf"^{_S}*[/(（]", said)
    told = pc.extract_regex(rest.filter(pa.array(more)), rf"^{_S}*(?:/(?P<ipa>[^/]*)/{_S}*)?(?:[(（](?P<aside>{_DOT}*)[)）]{_S}*)?(?P<b>{_DOT}*)$")
    more_at = np.flatnonzero(more)
    fits = within | behind | (said & ~more & even)
    fits[more_at] = _flags(told.is_valid())
    rest = _some(_some(rest, behind, lambda v: _drop(v, rf"^{_S}*{_COLON}")), more, lambda _: pc.struct_field(told, "b"))
    # a key without marks
    colon = ~bold & _flags(pc.or_(pc.match_substring(bare, ":"), pc.match_substring(bare, "：")))
    plain = np.flatnonzero(_fits(bare, _KEY_VALUE, colon) & ~_fits(bare, rf"^{_KEY}{_S}*{_COLON}//", colon & _flags(pc.match_substring(bare, "//"))))
    cut = pc.extract_regex(bare.take(pa.array(plain)), _AT_COLON)

    def placed(values: list[pa.Array], where: np.ndarray, what: np.ndarray) -> pa.Array:
        source = np.zeros(len(bare), np.int64)
        source[where] = what + 1
        return pa.concat_arrays([null, *values]).take(pa.array(source))

    where = np.concatenate([at[fits], plain])
    label = placed([terms, key, pc.struct_field(cut, "a")], where, np.concatenate([(code + np.where(within, len(terms), 0))[fits], 2 * len(terms) + np.arange(len(plain))]))
    value = placed([rest, pc.struct_field(cut, "b")], where, np.concatenate([np.flatnonzero(fits), len(rest) + np.arange(len(plain))]))
    of = lambda name: _full(placed([pc.struct_field(told, name)], at[more_at], np.arange(len(more_at))))
    return {"label": _plain(label), "value": _filled(_plain(value)), "ipa": of("ipa"), "aside": of("aside")}


def _cells(body: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many cells each table row has, and all cells; an escaped pipe belongs to its cell, and a line feed, which no line has, stands for it."""
    parts = pc.split_pattern(_drop(pc.replace_substring(body, "\\|", "\n"), r"^\||\|$"), "|")
    return _np(pc.list_value_length(parts)).astype(np.int64), _plain(pc.replace_substring(parts.flatten(), "\n", "|"))


def _past(data: np.ndarray, at: np.ndarray, end: np.ndarray, marks: bytes, most: int) -> np.ndarray:
    """Positions behind up to ``most`` of the marks."""
    at, more, fits = at.copy(), np.flatnonzero(at < end), np.isin(np.arange(256), list(marks))
    for _ in range(most):
        more = more[fits[data[at[more]]]]
        if not len(more):
            break
        at[more] += 1
        more = more[at[more] < end[more]]
    return at


def _counted(lines: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Lines with 0 for the number of a numbered item, so that items alike but for it are one; which lines these are, and their digits.

    Only what is short is looked for: a line with a longer indent, number or gap stays as it is.
    """
    at, data = _bytes(lines)
    begin = _past(data, at[:-1], at[1:], b" \t", SHORT)
    byte = lambda p, stop: np.where(p < stop, data[np.minimum(p, len(data) - 1)], 0) if len(data) else np.zeros(len(p), np.uint8)
    rows = np.flatnonzero(np.isin(byte(begin, at[1:]), list(b"0123456789")))
    begin, end = begin[rows], at[1:][rows]
    stop = _past(data, begin, end, b"0123456789", SHORT)
    word = _past(data, stop + 1, end, b" \t", SHORT)
    first = byte(word, end)
    fits = np.isin(byte(stop, end), list(b".)")) & (word > stop + 1) & (first > 32) & (first < 127)
    rows, begin, n = rows[fits], begin[fits], (stop - begin)[fits]
    if not len(rows):
        return lines, rows, pa.array([], pa.string())
    digits = np.repeat(begin, n) + _runs(n)
    numbers = pa.StringArray.from_buffers(len(rows), pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.py_buffer(data[digits]))
    keep, out, short = np.ones(len(data), bool), data.copy(), np.zeros(len(at), np.int32)
    keep[digits], keep[begin], out[begin] = False, True, ord("0")
    short[rows + 1] = n - 1
    made = pa.StringArray.from_buffers(len(lines), pa.py_buffer((at - at[0] - np.cumsum(short)).astype(np.int32)), pa.py_buffer(out[at[0] :][keep[at[0] :]]))
    return made, rows, numbers


def _odd(byte: np.ndarray) -> np.ndarray:
    """Whether a line's first byte but blanks leaves open what the line begins with, as it may be white space of another kind."""
    return (byte < 32) & (byte > 0) | (byte >= 127)


def _begins(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each line but spaces and tabs, 0 if there is none and 1 if it is far behind; whether the line begins with it."""
    at, data = _bytes(lines)
    begin = _past(data, at[:-1], at[1:], b" \t", SHORT)
    byte = np.zeros(len(lines), np.uint8)
    some = begin < at[1:]
    byte[some] = np.maximum(data[begin[some]], 1)
    byte[np.isin(byte, (9, 32))] = 1
    return byte, begin == at[:-1]


def _title(body: pa.Array) -> pa.Array:
    return _plain(_drop(_drop(_drop(body, rf"^#{{1,6}}{_S}+|{_S}+#+$"), rf"^\d+[.)]{_S}*"), rf"^{_SYMBOL}{_S}*"))


class Headings:
    """The headings among the lines of texts: ``at`` which positions, their ``level``, what they say, and by level the places of those that they stand under, themselves included."""

    def __init__(self, lines: pa.Array, counts: np.ndarray) -> None:
        n = len(lines)
        begin = np.cumsum(counts) - counts
        top = np.zeros(n + 1, bool)
        top[begin], top[n] = True, True
        end, top = top[1:], top[:-1]
        # by first bytes, what may be one: numbered lines stand alone, or before a point of the same number
        byte, flush = _begins(lines)
        odd, digit = _odd(byte), (byte >= 48) & (byte <= 57)
        free, point = odd | (byte == 0), odd | digit
        numbered = flush & digit & (((top | np.roll(free, 1)) & (end | np.roll(free, -1))) | (~end & np.roll(point, -1)))
        maybe = numbered | odd | (byte == ord("#")) | (flush & np.isin(byte, list(b"^`")))
        near = maybe | np.roll(numbered | odd, 1) & ~top | np.roll(numbered | odd, -1) & ~end
        maybe, near = np.flatnonzero(maybe), np.flatnonzero(near)
        coded = lines.take(pa.array(near)).dictionary_encode()
        text, code = coded.dictionary, np.zeros(n, np.int32)
        code[near] = _np(coded.indices)

        body = pc.utf8_trim(text, characters=WHITE)
        byte, blank, flush = _first(body), _np(pc.equal(body, "")).astype(bool), ~np.isin(_first(text), (9, 32))
        digit = np.isin(byte, list(b"0123456789"))
        marks = _np(pc.fill_null(pc.utf8_length(_group(body, rf"^(?P<a>#{{1,6}}){_S}+{_N}", byte == ord("#"))), 0)).astype(np.int32)
        symbol = _fits(body, rf"^{_SYMBOL}{_S}*[^\t-\r :：]+[^:：]*$", ((byte >= 128) | np.isin(byte, list(b"^`"))) & flush & (_np(pc.utf8_length(body)) <= 80))
        numbers = pa.concat_arrays([_group(body, rf"^(?P<a>\d+)[.)]{_S}", digit), _group(body, rf"^(?P<a>\d+)\.1{_S}", digit)])
        number, first = np.split(_np(pc.fill_null(numbers.dictionary_encode().indices, -1)), 2)
        can_stand = flush & (number >= 0) & ~_fits(body, rf"^\d+[.)]{_S}+\*\*", digit)
        sentence = _fits(body, "[.!?。！？;；]$", can_stand)
        at = maybe[can_stand[code[maybe]]]
        above, below = code[at - 1], code[(at + 1) % max(n, 1)]
        free = (top[at] | blank[above]) & (end[at] | blank[below]) & ~sentence[code[at]]
        alone = at[(~end[at] & (first[below] == number[code[at]])) | free]
        level = np.where(marks > 0, marks, np.where(symbol, 2, 0))
        is_one = level[code[maybe]]
        is_one[np.searchsorted(maybe, alone)] = 3
        self.at, self.level = maybe[is_one > 0], is_one[is_one > 0]
        self.text = _title(body.take(pa.array(code[self.at])))
        self.doc = np.searchsorted(begin, self.at, side="right") - 1
        start, place = begin[self.doc], np.arange(len(self.at))
        title = np.stack([np.maximum.accumulate(np.where(self.level == k, place, -1)) for k in range(1, LEVELS + 1)], axis=1)
        title = np.where((title >= 0) & (self.at[title] >= start[:, None]), title, -1) if len(place) else title
        self.under, self.shown = title, title > np.concatenate([np.full((len(place), 1), -1), np.maximum.accumulate(title, axis=1)[:, :-1]], axis=1)


class Lines:
    """Lines of documents, with their headings, among their neighbours: of each its text, number, kind, level and the positions of what it stands under."""

    def __init__(self, lines: pa.Array, counts: np.ndarray, headings: np.ndarray, levels: np.ndarray) -> None:
        flat, self.counted, self.numbers = _counted(lines)
        coded = flat.dictionary_encode()
        self.code = code = _np(coded.indices)
        self.doc, self.pos = np.repeat(np.arange(len(counts), dtype=np.int32), counts), np.arange(len(code), dtype=np.int32)
        self.begin = np.repeat((np.cumsum(counts) - counts).astype(np.int32), counts)
        self.line_no = self.pos - self.begin

        # each distinct line by itself
        self.body = body = pc.utf8_trim(coded.dictionary, characters=WHITE)
        byte = _first(body)
        one_of = lambda marks: np.isin(byte, list(marks))
        digit, row = one_of(b"0123456789"), byte == ord("|")
        lead = _group(coded.dictionary, r"^(?P<a>[ \t]*)", np.isin(_first(coded.dictionary), (9, 32)))
        indent = _np(pc.fill_null(pc.add(pc.binary_length(lead), pc.multiply(pc.count_substring(lead, "\t"), 3)), 0)).astype(np.int64)
        tests = [
            (_np(pc.equal(body, "")).astype(bool), BLANK), (row, ROW), (_fits(body, r"^(-{3,}|\*{3,}|_{3,})$", one_of(b"-*_")), RULE),
            (_fits(body, rf"^\d+\.\d+{_S}+{_N}", digit), POINT), (_fits(body, rf"^([-*+•]|\d+[.)]){_S}+{_N}", digit | one_of(b"-*+\xe2")), ITEM), (byte == ord(">"), QUOTE),
        ]
        self.kind = np.select([t for t, _ in tests], [np.int32(k) for _, k in tests], np.int32(TEXT))
        depth, aligned = np.where(self.kind == ITEM, (indent + 2) // 4, -1).astype(np.int32), _fits(body, rf"^\|?({_S}*:?-+:?{_S}*\|)+{_S}*(:?-+:?)?{_S}*$", row)

        # each line among its neighbours
        self.kinds, self.level, self.heading = self.kind[code], depth[code], np.zeros(len(code), bool)
        self.kinds[headings], self.level[headings], self.heading[headings] = HEADING, levels, True
        at_margin = (indent == 0)[code]
        self.head = row[code] & ((self.line_no == 0) | ~np.roll(row[code], 1))
        self.shown = (self.kinds != BLANK) & ~self.head & ~aligned[code]
        text = self.kinds == TEXT
        broken = self.last(self.heading | (self.kinds == ROW) | (self.kinds == RULE) | (text & at_margin))
        depth = np.where((text | (self.kinds == QUOTE)) & ~at_margin, np.int32(LEVELS), np.where(self.heading, np.int32(-1), self.level))
        self.parent = np.full(len(code), -1, np.int32)
        for d in range(LEVELS):
            items = (self.kinds == ITEM) & (self.level == d)
            if items.any():
                item = self.last(items)
                self.parent = np.where((d < depth) & (item > broken), np.maximum(self.parent, item), self.parent)

    def last(self, flag: np.ndarray) -> np.ndarray:
        """The position of the last flagged line up to each one of its document, -1 if there is none."""
        at = np.maximum.accumulate(np.where(flag, self.pos, np.int32(-1)))
        return np.where(at >= self.begin, at, np.int32(-1))

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
        """Of the lines at positions, which distinct one (in text and kind) each is; the kinds, texts and contents of these."""
        ids, of = _distinct(self.code[at] * 2 + self.heading[at], 2 * len(self.body))
        mine, heading = self.body.take(pa.array(ids // 2)), ids % 2 == 1
        kinds, byte = np.where(heading, HEADING, self.kind[ids // 2]), _first(mine)
        inner = np.isin(kinds, (ITEM, POINT, QUOTE))
        content = _some(mine, ~inner & ~heading & ((byte >= 128) | np.isin(byte, list(b"^`"))), lambda v: _drop(v, rf"^{_SYMBOL}{_S}*"))
        content = _some(content, inner, lambda v: _drop(v, rf"^(#{{1,6}}{_S}+|>{_S}?|([-*+•]|\d+[.)]|\d+\.\d+){_S}+)"))
        return of, kinds, mine, _some(content, heading, _title)

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """Of the table rows at positions: how many cells each distinct row or header has, all their cells, and which one each row and its header is."""
        codes, at = _distinct(np.concatenate([self.code[rows], self.code[self.last(self.head)[rows]]]), len(self.body))
        return *_cells(self.body.take(pa.array(codes))), at[: len(rows)], at[len(rows) :]


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of the texts, and how many each one has."""
    parts = pc.split_pattern(pc.replace_substring(texts, "\r\n", "\n") if 13 in _bytes(texts)[1] else texts, "\n")
    return parts.flatten(), _np(pc.fill_null(pc.list_value_length(parts), 0)).astype(np.int64)


def _bare(kinds: np.ndarray, content: pa.Array) -> pa.Array:
    """Contents without their check box; null for headings, rows and rules."""
    bare = _some(content, (kinds == ITEM) & (_first(content) == ord("[")), lambda v: _drop(v, rf"^\[[ xX]\]{_S}+"))
    return pc.if_else(pa.array(np.isin(kinds, (ITEM, POINT, TEXT, QUOTE))), bare, pa.scalar(None, pa.string()))


def parse(texts: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """The number of the text that each block lies in, and the blocks, in order."""
    flat, counts = _split(texts)
    headings = Headings(flat, counts)
    lines = Lines(flat, counts, headings.at, headings.level)
    shown, kinds = np.flatnonzero(lines.shown), lines.kinds
    of, k, mine, content = lines.read(shown)
    byte = _first(mine)
    box = _group(content, rf"^\[(?P<a>[ xX])\]{_S}", (k == ITEM) & (_first(content) == ord("[")))
    number = _group(mine, rf"^(?:#{{1,6}}{_S}+)?(?P<a>\d+(?:\.\d+)?)[.)]?{_S}", np.isin(byte, list(b"#0123456789")))
    local = {"kind": pa.array(KINDS).take(pa.array(k)), "content": content, "checked": pc.equal(pc.utf8_lower(box), "x"), **_pair(_bare(k, content))}
    out = {n: v.take(pa.array(of)) for n, v in local.items()}
    given = np.full(len(lines.pos), -1)
    given[lines.counted] = np.arange(len(lines.counted))
    out["number"] = pa.concat_arrays([number, lines.numbers]).take(pa.array(np.where(given[shown] >= 0, len(number) + given[shown], of)))

    # paths change at headings only; the last one is empty
    paths = _lists(np.append(headings.shown.sum(axis=1), 0), headings.text.take(pa.array(headings.under[headings.shown])))
    above = lines.last(lines.heading)[shown]
    out["path"] = paths.take(pa.array(np.where(above >= 0, np.searchsorted(headings.at, above), len(headings.at))))

    # cells by the header of their table, one longer than the other filled up
    table = kinds[shown] == ROW
    n_cells, cells, own, names = lines.cells(shown[table])
    starts = np.cumsum(n_cells) - n_cells
    width = np.maximum(n_cells[own], n_cells[names])
    step = _runs(width)
    pick = lambda r, values: values.take(pa.array(np.repeat(starts[r], width) + step, mask=step >= np.repeat(n_cells[r], width)))
    made = np.zeros(len(shown), np.int64)
    made[table] = width
    out["cells"] = _lists(made, pa.StructArray.from_arrays([pick(names, cells), pick(own, _filled(cells))], ["name", "value"]), ~table)

    # items at the margin hold what lies right under them
    up = lines.parent[shown]
    kids = np.flatnonzero(up >= 0)
    kids = kids[np.argsort(up[kids], kind="stable")]
    outer = (kinds[shown] == ITEM) & (up < 0)
    per = np.zeros(len(lines.pos), np.int64)
    np.add.at(per, up[kids], 1)
    kids = kids[outer[np.searchsorted(shown, up[kids])]]
    below_of = pa.StructArray.from_arrays([pa.array(lines.line_no[shown][kids], pa.int32()), *[out[n].take(pa.array(kids)) for n in ("label", "value", "content")]], ["line_no", "label", "value", "content"])
    out["fields"] = _lists(np.where(outer, per[shown], 0), below_of, ~outer)

    passed = np.cumsum(lines.head)
    table_no = passed - np.where(lines.begin > 0, passed[lines.begin - 1], 0) if len(passed) else passed
    out["line_no"] = pa.array(lines.line_no[shown], pa.int32())
    out["level"] = pa.array(lines.level[shown], pa.int32(), mask=lines.level[shown] < 0)
    out["table_no"] = pa.array(table_no[shown], pa.int64(), mask=~table)
    out["parent"] = pa.array(up - lines.begin[shown], pa.int32(), mask=up < 0)
    return lines.doc[shown], pa.StructArray.from_arrays([out[n].cast(t) for n, t in BLOCK], [n for n, _ in BLOCK])


def _named(names: pa.Array) -> Callable[[tuple[str, ...]], np.ndarray]:
    """Tells which names match the first of some patterns and none of the others; patterns are in lower case, of the names only A to Z are taken so."""
    coded = pc.ascii_lower(names).dictionary_encode()
    at, n = _np(pc.fill_null(coded.indices, len(coded.dictionary))), len(coded.dictionary)
    hit = lambda p: np.append(_flags(pc.match_substring_regex(coded.dictionary, p)), False)
    return lambda patterns: (hit(patterns[0]) & ~np.any([np.zeros(n + 1, bool), *map(hit, patterns[1:])], axis=0))[at]


def parse_parts(texts: pa.Array, title: str, fields: dict[str, tuple[str, ...]], cells: dict[str, str]) -> tuple[np.ndarray, pa.StructArray]:
    """As ``parse``, of items at the margin (and table rows, if ``cells`` has names) under a matching heading, what ``blocks.parts`` returns."""
    flat, counts = _split(texts)
    headings = Headings(flat, counts)
    # what stands between two headings is read by itself, if it is under a matching one
    fits = _named(headings.text)((title,))
    within = (headings.shown & np.append(fits, False)[headings.under]).any(axis=1)
    stop = np.minimum(np.append(headings.at[1:], len(flat)), np.cumsum(counts)[headings.doc]) if len(fits) else headings.at
    start, size = headings.at[within] + 1, (stop - headings.at - 1)[within]
    none = np.zeros(0, np.int64)
    flat = flat.take(pa.array(np.repeat(start, size) + _runs(size)))
    lines = Lines(flat, size, none, none)
    outer = lines.shown & (lines.kinds == ITEM) & (lines.parent < 0)
    rows, items = np.flatnonzero(lines.shown & (lines.kinds == ROW) & bool(cells)), np.flatnonzero(outer)
    kids = np.flatnonzero(lines.shown & (lines.parent >= 0))
    kids = kids[outer[lines.parent[kids]]]

    order = np.argsort(np.concatenate([rows, items]), kind="stable")
    nothing = np.full(len(rows), -1)
    taken = lambda values, of_rows, of_items: values.take(pa.array(at := np.concatenate([of_rows, of_items])[order], mask=at < 0))
    both, k, _, content = lines.read(np.concatenate([items, kids]))
    pair, (item, kid) = _pair(_bare(k, content)), np.split(both, [len(items)])
    n_cells, values, own, names = lines.cells(rows)
    starts, filled = np.cumsum(n_cells) - n_cells, _filled(values)
    header = np.unique(names)
    line_of = np.repeat(header, n_cells[header])
    titles = np.repeat(starts[header], n_cells[header]) + _runs(n_cells[header])
    headed, labelled = _named(values.take(pa.array(titles))), _named(pair["label"].take(pa.array(kid)))
    owner = np.searchsorted(items, lines.parent[kids])
    out = [pa.array(["row", "item"]).take(pa.array(np.repeat([0, 1], [len(rows), len(items)])[order])), *[taken(pair[n], nothing, item) for n in PARTS[1:]]]
    parts = pa.concat_arrays([filled, pair["value"]])
    for name in {**fields, **cells}:
        of_rows, of_items = nothing, np.full(len(items), -1)
        if name in cells:
            # the first column of each distinct header that matches, beyond all others if none does
            found = np.flatnonzero(headed((cells[name],)))[::-1]
            column = np.full(len(n_cells), len(values))
            column[line_of[found]] = titles[found] - starts[line_of[found]]
            of_rows = np.where(column[names] < n_cells[own], starts[own] + column[names], -1)
        if name in fields:
            found = np.flatnonzero(labelled(fields[name]))[::-1]
            of_items[owner[found]] = len(filled) + kid[found]
        out.append(taken(parts, of_rows, of_items))
    return headings.doc[within][lines.doc[np.concatenate([rows, items])[order]]], pa.StructArray.from_arrays(out, [*PARTS, *[f"its_{n}" for n in {**fields, **cells}]])


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the last column, the text, has about ``PIECE`` bytes, and 16 more for each line."""
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        at, data = _bytes(text)
        size = (at[1:] - at[0]) + 16 * np.searchsorted(np.flatnonzero(data[at[0] : at[-1]] == 10), at[1:] - at[0])
        begin = 0
        while begin < batch.num_rows:
            done = size[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(size, done + PIECE, side="right")))
            yield batch.slice(begin, stop - begin)
            pa.default_memory_pool().release_unused()
            begin = stop


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block, with the columns before the text."""
    for batch in pieces(batches):
        yield from _rows(batch, *parse(batch.column(batch.num_columns - 1)))


def part_rows(batches: Iterator[pa.RecordBatch], title: str, fields: dict[str, tuple[str, ...]], cells: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """One row for each item or row, as ``blocks.parts`` says, with the columns before the text."""
    for batch in pieces(batches):
        yield from _rows(batch, *parse_parts(batch.column(batch.num_columns - 1), title, fields, cells))


def _rows(batch: pa.RecordBatch, doc: np.ndarray, found: pa.StructArray) -> Iterator[pa.RecordBatch]:
    names = batch.schema.names[:-1]
    for begin in range(0, len(doc), 1 << 16):
        part = slice(begin, begin + (1 << 16))
        keys = [batch.column(i).take(pa.array(doc[part])) for i in range(len(names))]
        yield pa.RecordBatch.from_arrays([*keys, *found[part].flatten()], [*names, *[f.name for f in found.type]])


def block_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text: the columns before it, and the list of its blocks."""
    for batch in pieces(batches):
        doc, found = parse(batch.column(batch.num_columns - 1))
        names = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], _lists(np.bincount(doc, minlength=batch.num_rows), found)], [*names, "blocks"])
