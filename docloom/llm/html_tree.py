"""Blocks and containers of one page of HTML, read in one pass.

Time and memory are linear in the page, whatever its markup: no search runs past a place
where the same search failed before, open elements are found by their tag, and a container
knows its parent instead of its whole path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

#: A tag without a quoted or stray angle bracket; all others go the slower way.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
QUOTE = re.compile(r"""=\s*+(["'])""")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.IGNORECASE)
#: Attributes that keep an element from the reader's eyes, in a tag without its quoted values and with them.
HIDDEN = re.compile(r"\shidden(?=[\s=/]|$)", re.IGNORECASE)
UNSEEN = re.compile(r"""\saria-hidden\s*=\s*["']?true|\sstyle\s*=\s*(?:"[^"]*?(?:display\s*:\s*none|visibility\s*:\s*hidden)|'[^']*?(?:display\s*:\s*none|visibility\s*:\s*hidden))""", re.IGNORECASE)
QUOTED = re.compile(r"""=\s*(?:"[^"]*+"|'[^']*+')""")
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$""")
_LONG_NUMBER = re.compile(r"&#\d{8,}")
# HTML elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What stands in these is no markup; scripts and styles run to the end of the page if they are not closed.
RAW = frozenset("script style title textarea iframe noframes noembed xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("html body main article section div td center blockquote form".split())
KEEPS_P = frozenset("caption legend summary td th tr tbody thead tfoot".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
LISTS = ("ul", "ol", "dl", "table", "menu")
IN_HEAD = frozenset("meta link title style script base noscript template head html".split())
NOISE_TAGS = frozenset("nav footer aside menu search dialog button head select datalist template noscript canvas audio video svg annotation annotation-xml".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related reply replies respond "
    "search share sharing sidebar sidenav signup social sponsor sponsored subscribe toolbar topbar widget widgets adsbygoogle taboola outbrain paywall notification notifications responses discussion "
    "werbung anzeige anzeigen kommentar kommentare publicite annonce annonces commentaire commentaires publicidad anuncio anuncios comentario comentarios seitenleiste fusszeile kopfzeile".split()
)
#: Words that may stand beside one of those in a name; any other word gives the name a meaning of its own.
PLAIN_NAMES = frozenset(
    "a area article articles aside bar block body bottom box btn button buttons card cards center class col column content css desktop entry first fixed footer global head icon icons id inner item items last left line link links list lists main mini mobile module open page panel post posts primary right root "
    "row rows secondary section site slot small google gpt dfp x reader readers user users visitor visitors static sticky stories story teaser teasers text thread title top ui unit units view wide wp".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: A first word that says something about another element, and a last one that names a layout wrapper: neither makes noise.
ABOUT = frozenset("has with no without is".split())
WRAPPERS = frozenset("wrap wrapper container layout".split())
#: Readers' talk can be longer than the page's own text, so only an article or main inside frees it.
TALK = frozenset("comment comments commentlist disqus reply replies respond responses discussion kommentar kommentare commentaire commentaires comentario comentarios".split())
#: A wrapper named after one of these wraps nothing else.
SELF_WRAPPED = TALK | frozenset("ad ads advert adverts advertisement advertising adsbygoogle cookie cookies consent gdpr newsletter notification notifications paywall popup modal promo sponsor sponsored subscribe taboola outbrain werbung anzeige anzeigen publicite annonce annonces publicidad anuncio anuncios".split())
#: Elements whose own class never makes them noise: themes put all kinds of names there.
TRUSTED = frozenset("html body main article".split())
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")


class Page(NamedTuple):
    """Blocks (container, text, characters in links) in page order; each container's label, parent and last inner container."""

    blocks: list[tuple[int, str, int]]
    labels: list[str]
    parents: list[int]
    last: list[int]


class _Open:
    __slots__ = ("tag", "noise", "container", "link", "doubt", "main", "article", "inline")

    def __init__(self, tag: str, noise: bool, container: int, link: bool, doubt: int, main: int, article: bool) -> None:
        self.tag, self.noise, self.container, self.link, self.doubt, self.main, self.article = tag, noise, container, link, doubt, main, article
        self.inline: dict[str, int] | None = None


class _Seeker:
    """Searches that never look again where nothing was."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.none: dict[str, int] = {}

    def find(self, what: str, at: int) -> int:
        stop = self.none.get(what, len(self.html))
        found = self.html.find(what, at, stop + len(what)) if at < stop else -1
        if found < 0:
            self.none[what] = min(at, stop)
        return found

    def closer(self, tag: str, at: int) -> int:
        """Where the end tag of a raw element begins; -1 if there is none."""
        if at >= self.none.get("</" + tag, len(self.html)):
            return -1
        found = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(self.html, at)
        if found is None:
            self.none["</" + tag] = at
        return found.start() if found else -1

    def tag_end(self, at: int) -> int:
        """Past the ``>`` that ends the tag at ``at``; one inside a quoted value does not.  -1 if there is none."""
        end = self.find(">", at)
        while end >= 0:
            quote = QUOTE.search(self.html, at, end)
            closing = self.find(quote[1], quote.end()) if quote else -1
            if closing < 0:
                return end + 1
            if closing > end:
                later = self.find(">", closing + 1)
                if later < 0:
                    return end + 1
                end = later
            at = closing + 1
        return -1


def plain(text: str) -> str:
    """``text`` with its character references decoded."""
    if "&" not in text:
        return text
    # a number of any length stands for no character
    return unescape(_LONG_NUMBER.sub("&#99999999", text) if "&#" in text else text)


def _names(attributes: dict[str, str]) -> Iterator[list[str]]:
    """The words of each class and of the id."""
    for key in ("class", "id"):
        for name in attributes.get(key, "").split():
            if words := _WORDS.findall(_CAMEL.sub(" ", name).lower()):
                yield words


def unseen(tag: str, body: str) -> bool:
    """Whether the attributes of a tag hide it; the page's outer elements and its article never count as hidden."""
    if tag in TRUSTED or ("hidden" not in body.lower() and "none" not in body.lower()):
        return False
    return UNSEEN.search(body) is not None or HIDDEN.search(QUOTED.sub("=", body)) is not None


def doubtful(tag: str, attributes: dict[str, str], inside_article: bool) -> tuple[bool, bool]:
    """Whether a name says that the element is noise, and whether one says that it is readers' talk.

    A name does so if it is made of such words and plain ones only: ``related-posts``, not ``related-work``.
    """
    noise = talk = False
    for words in _names(attributes):
        if words[-1] in WRAPPERS and not SELF_WRAPPED.isdisjoint(words):
            words = [w for w in words if w not in WRAPPERS]
        if words[0] in ABOUT or words[-1] in WRAPPERS or (inside_article and words[-1] == "header") or (tag == "section" and words == ["discussion"]):
            continue
        if all(w in NOISE_NAMES or w in PLAIN_NAMES for w in words):
            noise = noise or not NOISE_NAMES.isdisjoint(words)
            talk = talk or not TALK.isdisjoint(words)
    return (noise and tag not in TRUSTED) or (talk and tag == "article"), talk


class _Reader:
    def __init__(self, html: str) -> None:
        self.html = html
        self.found: list[tuple[int, list[tuple[str, int, bool, int]]]] = []
        self.pieces: list[tuple[str, int, bool, int]] = []
        self.doubts: list[tuple[int, bool]] = [(-1, False)]
        self.labels, self.parents = [""], [-1]
        root = _Open("", False, 0, False, 0, 0, False)
        root.inline = {}
        self.stack = [root]
        self.blocks = [0]
        self.where: dict[str, list[int]] = {}

    def flush(self) -> None:
        if self.pieces:
            self.found.append((self.stack[-1].container, self.pieces))
            self.pieces = []

    def open_at(self, *tags: str) -> int:
        """The place of the innermost open element with one of ``tags``; 0 if there is none."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def close(self, depth: int) -> None:
        if self.blocks[-1] >= depth:
            self.flush()
        while len(self.stack) > depth:
            gone = self.stack.pop()
            self.where[gone.tag].pop()
            if gone.inline is not None:
                self.blocks.pop()
            else:
                self.stack[self.blocks[-1]].inline[gone.tag] -= 1

    def text(self, raw: str) -> None:
        top = self.stack[-1]
        if top.tag == "head" and not raw.isspace():
            self.close(len(self.stack) - 1)
            top = self.stack[-1]
        if not top.noise:
            self.pieces.append((plain(raw), top.doubt, top.link, top.main))

    def end_tag(self, tag: str) -> None:
        if tag not in BLOCKS:
            if self.stack[self.blocks[-1]].inline.get(tag):
                self.close(self.where[tag][-1])
            return
        # what stands in a table's cell closes nothing outside it
        least = 0 if tag in KEEPS_P or tag in ("table", "body", "html") else self.open_at("td", "th", "caption")
        depth = self.open_at(*HEADINGS) if tag in HEADINGS else self.open_at(tag)
        if depth > least:
            self.close(depth)
        else:
            self.flush()

    def start_tag(self, tag: str, body: str) -> None:
        where = self.where
        if tag not in IN_HEAD and where.get("head"):
            self.close(where["head"][-1])
        if tag in BLOCKS:
            for unfit in ("svg", "select"):
                if where.get(unfit):
                    self.close(where[unfit][-1])
            self.flush()
            if tag not in KEEPS_P and self.stack[self.blocks[-1]].tag == "p":
                self.close(self.blocks[-1])
        if tag in SIBLINGS and (other := self.open_at(*SIBLINGS[tag])) > self.open_at(*LISTS):
            self.close(other)
        if tag in VOID or (tag in ("svg", "math") and SELF_CLOSED.search(body)):
            return
        top = self.stack[-1]
        attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(body)} if "=" in body else {}
        noise = top.noise or tag in NOISE_TAGS or (tag == "header" and not top.article) or attributes.get("role", "").lower() in NOISE_ROLES or unseen(tag, body)
        named, talk = (False, False) if noise or not attributes else doubtful(tag, attributes, top.article)
        doubt = top.doubt
        if (named or tag == "form") and not noise:
            self.doubts.append((doubt, talk))
            doubt = len(self.doubts) - 1
        # an article of readers' talk, as a comment may be, is none of the page's
        own = tag in ("article", "main") and not talk
        container = top.container
        if tag in CONTAINERS:
            classes = sorted(_DIGITS.sub("#", c) for c in attributes.get("class", "").split())
            self.labels.append(".".join([tag, *classes]))
            self.parents.append(container)
            container = len(self.labels) - 1
        new = _Open(tag, noise, container, top.link or tag == "a", doubt, int(top.main or own), top.article or tag in ("article", "main", "section"))
        where.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            new.inline = {}
            self.blocks.append(len(self.stack))
        else:
            inline = self.stack[self.blocks[-1]].inline
            inline[tag] = inline.get(tag, 0) + 1
        self.stack.append(new)

    def read(self) -> Page:
        html, seek = self.html, _Seeker(self.html)
        at, end = 0, len(html)
        while at < end:
            begin = html.find("<", at)
            if begin != at:
                self.text(html[at : begin if begin >= 0 else end])
                if begin < 0:
                    break
            m = TAG.match(html, begin)
            if m:
                closing, tag, body, at = m[1], m[2].lower(), m[3], m.end()
            else:
                after = html[begin + 1 : begin + 2]
                if html.startswith("<!--", begin):
                    stop = begin + 5 if html.startswith(">", begin + 4) else begin + 6 if html.startswith("->", begin + 4) else seek.find("-->", begin + 4) + 3
                    at = stop if stop > 2 else end
                    continue
                name = NAME.match(html, begin)
                if name is None:
                    if after in ("!", "?", "/") and after:
                        stop = seek.find(">", begin + 2)
                        at = stop + 1 if stop >= 0 else end
                    else:
                        self.text("<")
                        at = begin + 1
                    continue
                stop = seek.tag_end(name.end())
                if stop < 0:  # the page ends inside a tag
                    break
                closing, tag, body, at = html[begin + 1] == "/", name[1].lower(), html[name.end() : stop - 1], stop
            if tag == "br":
                top = self.stack[-1]
                self.pieces.append(("\n", top.doubt, False, top.main))
            elif closing:
                self.end_tag(tag)
            elif tag in RAW:
                if not SELF_CLOSED.search(body[-2:]):
                    stop = seek.closer(tag, at)
                    if stop >= 0:
                        stop = seek.find(">", stop)
                        at = stop + 1 if stop >= 0 else end
                    elif tag in ("script", "style"):
                        at = end
            else:
                self.start_tag(tag, body)
        self.flush()
        last = list(range(len(self.labels)))
        for c in range(len(last) - 1, 0, -1):
            last[self.parents[c]] = max(last[self.parents[c]], last[c])
        return Page(self.judged(), self.labels, self.parents, last)

    def judged(self) -> list[tuple[int, str, int]]:
        """The blocks without the pieces of doubtful elements that hold too little of the page.

        Such an element stays if it holds most of the text of the page's articles or main,
        or (readers' talk apart) of the page.
        """
        doubts = self.doubts
        whole, main = [0] * len(doubts), [0] * len(doubts)
        for _, pieces in self.found:
            for text, doubt, _, inside in pieces:
                n = sum(map(len, text.split()))
                whole[doubt] += n
                main[doubt] += n * inside
        for d in range(len(doubts) - 1, 0, -1):
            whole[doubts[d][0]] += whole[d]
            main[doubts[d][0]] += main[d]
        noise = [False] * len(doubts)
        for d in range(1, len(doubts)):
            above, talk = doubts[d]
            most = 2 * main[d] > main[0] if main[0] else not talk and 2 * whole[d] > whole[0]
            noise[d] = noise[above] or not most
        blocks = []
        for container, pieces in self.found:
            kept = [p for p in pieces if not noise[p[1]]]
            text = " ".join("".join(p[0] for p in kept).split())
            if text:
                blocks.append((container, text, sum(len(p[0]) for p in kept if p[2])))
        return blocks


def parse(html: str) -> Page:
    """The blocks outside noise and the containers of a page."""
    return _Reader(html).read()
