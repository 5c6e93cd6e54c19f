"""Text preparation as Column expressions: HTML bodies, links, redaction, prompts, keys and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts and patterns that results must carry.
REDACTED = " [链接已移除] "
DEFAULT_TITLE = "AI 日报 "
URLS = r"https?://\S+|www\.\S+|ftp://\S+"
#: All characters that count as white space, as text and as a pattern: those of Unicode and the four separators before the space.
WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def body_of(html: Column) -> Column:
    """The inner body without script elements; a page without a body comes back untouched, scripts included."""
    clean = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script\s*>", "")
    return F.when(clean.rlike(r"(?i)<body\b"), F.regexp_extract(clean, r"(?is)<body\b[^>]*>(.*?)(</body\s*>|\z)", 1)).otherwise(html)


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends; null stays null."""
    return F.trim(text, F.lit(WHITE))


def compact(text: Column) -> Column:
    """Every run of white space, of any kind, as one space, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


# One attribute of a tag that is not href; quoted values may hold ">".
_ATTRIBUTE = r"""[\s/]*+(?!href[\s=>])[^\s=>"'/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+"""
_BEFORE_HREF = rf"(?i)(<a(?=[\s/])(?:{_ATTRIBUTE})*+[\s/]*+href\s*+=\s*+"


def absolute_links(html: Column, url: Column) -> Column:
    """Links of anchors that begin with one slash, made absolute by the scheme and authority of ``url``.

    Values may stand in double or single quotes or in none.  Other attributes, such as
    ``data-href``, and links that begin with two slashes stay.  A page whose url is null,
    malformed or without a scheme comes back as it is, and so does null html.
    """
    base = F.concat(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), F.try_parse_url(url, F.lit("AUTHORITY")))
    into = F.concat(F.lit("$1"), F.regexp_replace(base, r"([\\$])", r"\\$1"), F.lit("$2"))
    done = html
    for value in (r'")(/(?!/)[^"]*")', r"')(/(?!/)[^']*')", r""")(/(?!/)[^\s"'>]*)"""):
        done = F.regexp_replace(done, F.lit(_BEFORE_HREF + value), into)
    return F.coalesce(done, html)


def truncate(text: Column, limit: int = 30_000) -> Column:
    return F.substring(text, 1, limit)


def redact_urls(text: Column) -> Column:
    return F.regexp_replace(text, URLS, REDACTED)


def count_urls(text: Column) -> Column:
    return F.regexp_count(text, F.lit(URLS))


def prompt_prefix(template: Column, body: Column) -> Column:
    return F.concat(template, body)


def prompt_suffix(body: Column, template: Column) -> Column:
    return F.concat_ws("\n\n", body, template)


def prompt_framed(template: Column, default: str, body: Column, line: str = "---") -> Column:
    """Template (or the default where it is missing), a separator line, then the body."""
    return F.concat(F.coalesce(template, F.lit(default)), F.lit(f"\n\n{line}\n\n"), body)


def messages(user: Column, system: Column | None = None) -> Column:
    """A chat message list, with a system message only where one is given."""
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    alone = F.array(one("user", user))
    return alone if system is None else F.when(system.isNull(), alone).otherwise(F.array(one("system", system), one("user", user)))


def date_key(moment: Column, override: Column | None = None) -> Column:
    day = F.date_format(moment, "yyyy-MM-dd")
    return day if override is None else F.coalesce(override, day)


def time_key(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH-mm-ss")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def swap_extension(path: Column, to: str) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", to)


def slug(title: Column) -> Column:
    return F.regexp_replace(title, r"[^A-Za-z0-9._-]+", "_")


def split_list(text: Column, separator: str = ",") -> Column:
    """Items without outer white space, those that are empty left out; null gives an empty list."""
    items = F.transform(F.split(text, separator), strip)
    return F.coalesce(F.filter(items, lambda x: x != ""), F.array().cast("array<string>"))


def digits(text: Column) -> Column:
    """The digits of a text as an integer, null if none is left."""
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).try_cast("bigint")


def report_title(title: Column, tags: Column, date: Column) -> Column:
    """The given title if it and its tags are there, else the default of the day."""
    return F.when((title != "") & (F.size(tags) > 0), title).otherwise(F.concat(F.lit(DEFAULT_TITLE), date))


def mail_subject(title: Column, date: Column) -> Column:
    return F.concat(F.lit("["), date, F.lit(" 摘要] "), title)


def input_status(record: Column, text: Column) -> Column:
    return F.when(record.isNull(), "extract_failed").when(F.coalesce(text, F.lit("")) == "", "empty").otherwise("ok")


def junk_signals(text: Column) -> dict[str, Column]:
    """Measures by which junk is told: length, share of symbols, share of repeated lines."""
    lines = F.split(text, "\n")
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|!]", ""))
    return {
        "n_len": F.length(text).cast("long"),
        "symbol_share": F.round(symbols / F.greatest(F.length(text), F.lit(1)), 6),
        "repeat_share": F.round(1 - F.size(F.array_distinct(lines)) / F.size(lines), 6),
    }


def is_junk(signals: dict[str, Column], least: int = 40, symbols: float = 0.05, repeats: float = 0.5) -> Column:
    return (signals["n_len"] < least) | (signals["symbol_share"] > symbols) | (signals["repeat_share"] > repeats)


def tail(text: Column, separator: str) -> Column:
    """The last piece of a text without outer white space."""
    return F.element_at(F.split(strip(text), separator), -1)


def concat_all(parts: Sequence[Column]) -> Column:
    return F.concat(*parts)
