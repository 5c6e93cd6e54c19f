"""Recovery, checking and reshaping of noisy JSON as Column expressions.

Spark's JSON readers ignore text after the first value, so a text counts as JSON only if
it also parses as the sole element of an array and as a member of an object.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns by which fenced or embedded JSON is found, in their order.
JSON_FENCE = r"(?s)```json\s*(.*?)\s*```"
ANY_FENCE = r"(?s)```\s*(.*?)\s*```"
BRACES = r"(?s)(\{.*\})"
REPORT = "array<struct<category:string,items:array<struct<title:string,content:string,links:array<struct<text:string,url:string>>>>>>"


def is_json(text: Column) -> Column:
    """True where the whole text is one JSON value."""
    boxed = F.concat(F.lit("["), text, F.lit("]"))
    member = F.concat(F.lit('{"v":'), text, F.lit("}"))
    return F.coalesce(F.try_parse_json(boxed).isNotNull() & F.try_parse_json(member).isNotNull() & (F.json_array_length(boxed) == 1), F.lit(False))


def _first(text: Column, pattern: str) -> Column:
    """The inside of the first match, the whole match if the inside is empty, null without a match."""
    inner = F.trim(F.regexp_extract(text, pattern, 1))
    return F.when(text.rlike(pattern), F.when(inner != "", inner).otherwise(F.regexp_extract(text, pattern, 0)))


def embedded(text: Column) -> Column:
    """What the first fitting pattern finds in a text, null if none fits."""
    return F.coalesce(_first(text, JSON_FENCE), _first(text, ANY_FENCE), _first(text, BRACES))


def recover(text: Column, found: Column) -> tuple[Column, Column]:
    """(json, stage): the text itself, or what is ``embedded`` in it, if that is JSON; else null and ``none``."""
    name = F.when(text.rlike(JSON_FENCE), "json_fence").when(text.rlike(ANY_FENCE), "fence").otherwise("braces")
    stage = F.when(is_json(text), "direct").when(is_json(found), name).otherwise("none")
    return F.when(stage == "direct", text).when(stage != "none", found), stage


def strip_fence(text: Column) -> Column:
    """The inside of the first fence that has one, else the trimmed text."""
    text = F.trim(text)
    fenced = F.when(text.rlike(JSON_FENCE), F.regexp_extract(text, JSON_FENCE, 1)).otherwise(F.regexp_extract(text, ANY_FENCE, 1))
    return F.coalesce(F.nullif(F.trim(fenced), F.lit("")), text)


def unwrap_report(json: Column) -> Column:
    """The report array: an array itself, or an object's first value that is an array of objects with a category; else null."""
    fields = F.map_entries(F.from_json(json, "map<string,string>"))
    reports = F.filter(fields, lambda e: e["value"].rlike(r"^\s*\[\s*\{") & F.array_contains(F.json_object_keys(F.get_json_object(e["value"], "$[0]")), "category"))
    head = F.left(F.ltrim(json), F.lit(1))
    return F.when(~is_json(json), None).when(head == "[", json).when(head == "{", F.try_element_at(reports, F.lit(1))["value"])


def title_object(json: Column) -> Column:
    """The JSON if it is an object with the key ``title``, else null."""
    return F.when(is_json(json) & (F.left(F.ltrim(json), F.lit(1)) == "{") & F.array_contains(F.json_object_keys(json), "title"), json)


def response_content(body: Column) -> tuple[Column, Column]:
    """(content, status) of a chat response; a missing or empty content has the status ``empty``."""
    content = F.get_json_object(body, "$.choices[0].message.content")
    return content, F.when(F.coalesce(content, F.lit("")) == "", "empty").otherwise("ok")


def local_response(body: Column) -> tuple[Column, Column]:
    """(response, looks_like_error) of a local model's response; the value is kept either way."""
    value = F.get_json_object(body, "$.response")
    low = F.lower(F.coalesce(value, F.lit("")))
    return value, low.contains("error") | low.contains("not a valid json")


def article(body: Column) -> tuple[Column, Column, Column]:
    """(title, text, status) of the first object of an article response, with defaults; no object gives ``extract_failed``."""
    first = F.get_json_object(body, "$.objects[0]")
    title = F.coalesce(F.get_json_object(first, "$.title"), F.lit("无标题"))
    text = F.coalesce(F.get_json_object(first, "$.text"), F.lit(""))
    return F.when(first.isNotNull(), title), F.when(first.isNotNull(), text), F.when(first.isNull(), "extract_failed").when(text == "", "empty").otherwise("ok")


def report_fault(json: Column) -> Column:
    """The first fault of a report in document order, null for a valid one.

    Faults: ``not_a_list``, ``empty``, ``keys`` (of a category), ``items``, ``article_keys``,
    ``links``, ``link_keys``.  A key counts as present when its value is null.
    """
    elements = lambda c: F.from_json(c, "array<string>")
    has = lambda o, *keys: F.forall(F.array(*map(F.lit, keys)), lambda k: F.array_contains(F.coalesce(F.json_object_keys(o), F.array().cast("array<string>")), k))
    is_list = lambda c: F.coalesce(c.rlike(r"^\s*\["), F.lit(False))
    first = lambda faults: F.try_element_at(F.filter(faults, lambda f: f.isNotNull()), F.lit(1))

    def link_fault(link: Column) -> Column:
        return F.when(~has(link, "text", "url"), "link_keys")

    def article_fault(item: Column) -> Column:
        links = F.get_json_object(item, "$.links")
        return F.when(~has(item, "title", "content", "links"), "article_keys").when(~is_list(links), "links").otherwise(first(F.transform(elements(links), link_fault)))

    def category_fault(category: Column) -> Column:
        items = F.get_json_object(category, "$.items")
        bad_items = ~is_list(items) | (F.coalesce(F.json_array_length(items), F.lit(0)) == 0)
        return F.when(~has(category, "category", "items"), "keys").when(bad_items, "items").otherwise(first(F.transform(elements(items), article_fault)))

    return F.when(json.isNull() | ~is_list(json), "not_a_list").when(F.json_array_length(json) == 0, "empty").otherwise(first(F.transform(elements(json), category_fault)))


def report(json: Column) -> Column:
    return F.from_json(json, REPORT)
