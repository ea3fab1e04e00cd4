"""B2: HTML boards read by selectors, as array functions over a page's tags: no page leaves the JVM.

A page falls into tags and what stands between them; a fold over these finds the elements that a selector fits, each from its
start tag to the end tag that balances it. Of elements that fit inside one another the outermost count. An element that
nothing closes reaches to the end of what it stands in.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import collapse_ws, decode_attr_entities
from feedloom.operators.lifecycle import first_per_key
from feedloom.operators.normalise import board_external_id

_VOID = "area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr"
#: A comment, a script or style with its content, a tag, or what stands between tags.
_TOKENS = r"(?is)<!--.*?-->|<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>|<[^>]*>|[^<]+|<"


@dataclass(frozen=True)
class HtmlBoard:
    """Selectors are tags, .classes, #ids and [attributes], with spaces for descent. A field may be `selector@attribute`."""

    item: str
    title: str
    link: str = "a@href"
    location: str | None = None
    fixed_location: str | None = None
    exclude_title: str | None = None
    capture_title: str | None = None
    id_attribute: str | None = None
    jd: str | None = None


def _start_pattern(simple: str) -> str:
    """The start tags that a simple selector fits."""
    tag = re.match(r"[\w-]*", simple)[0] or r"[a-zA-Z][\w-]*"
    names = re.findall(r"([.#])([\w-]+)", re.sub(r"\[[^\]]*\]", "", simple))
    looks = [rf"(?=[^>]*\sclass\s*=\s*(?:\"[^\">]*(?<![\w-]){n}(?![\w-])|'[^'>]*(?<![\w-]){n}(?![\w-])|{n}[\s>]))" if k == "." else rf"(?=[^>]*\sid\s*=\s*[\"']?{n}[\"'\s>])" for k, n in names]
    for k, v in re.findall(r"\[([\w-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]", simple):
        looks.append(rf"(?=[^>]*\s{k}\s*=\s*[\"']?{re.escape(v)}[\"'\s>])" if v else rf"(?=[^>]*\s{k}[\s=>])")
    return rf"(?is)^<{tag}(?=[\s>/]){''.join(looks)}"


def _elements(html: Column, simple: str) -> Column:
    """The outermost elements that a simple selector fits, in order, as text."""
    tokens = F.regexp_extract_all(html, F.lit(_TOKENS), F.lit(0))
    spans = F.array().cast("array<struct<at:int,size:int>>")
    begin = F.struct(F.lit("").alias("tag"), F.lit(0).alias("depth"), F.lit(0).alias("start"), F.lit(0).alias("at"), spans.alias("spans"))
    span = lambda at, end: F.struct(at.alias("at"), (end - at).alias("size"))

    def step(s: Column, token: Column) -> Column:
        end = s["at"] + F.char_length(token)
        name = F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][\w-]*)", 1))
        alone = token.rlike(rf"(?is)^<(?:{_VOID})\b|/>$|^<(?:script|style)\b.*</")
        moved = lambda tag, depth, start, found: F.struct(tag.alias("tag"), depth.alias("depth"), start.alias("start"), end.alias("at"), found.alias("spans"))
        fits = (s["tag"] == "") & token.rlike(_start_pattern(simple))
        depth = s["depth"] + F.when((name != s["tag"]) | alone, 0).when(token.startswith("</"), -1).otherwise(1)
        closed = (s["tag"] != "") & (depth == 0)
        return (
            F.when(fits & alone, moved(F.lit(""), F.lit(0), F.lit(0), F.array_append(s["spans"], span(s["at"], end)))).when(fits, moved(name, F.lit(1), s["at"], s["spans"]))
            .when(closed, moved(F.lit(""), F.lit(0), F.lit(0), F.array_append(s["spans"], span(s["start"], end)))).when(s["tag"] != "", moved(s["tag"], depth, s["start"], s["spans"]))
            .otherwise(moved(F.lit(""), F.lit(0), F.lit(0), s["spans"]))
        )

    found = F.aggregate(tokens, begin, step, lambda s: F.when(s["tag"] != "", F.array_append(s["spans"], span(s["start"], s["at"]))).otherwise(s["spans"]))
    return F.transform(found, lambda x: F.substring(html, x["at"] + 1, x["size"]))


def select(html: Column, selector: str) -> Column:
    """The elements that a selector fits, in order, as text."""
    # Below the first level the elements' own tags are left out: what fits must lie inside.
    below = lambda simple: lambda h: _elements(F.regexp_replace(h, r"^<[^>]*>", ""), simple)
    first, *rest = selector.split()
    found = _elements(html, first)
    for simple in rest:
        found = F.flatten(F.transform(found, below(simple)))
    return found


def _plain(html: Column) -> Column:
    """Text of an element: no scripts, no tags, entities decoded."""
    return decode_attr_entities(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", ""), r"<[^>]*>", ""))


def _attribute(element: Column, name: str) -> Column:
    tag = F.regexp_extract(element, r"^<[^>]*>", 0)
    value = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", 1)
    value = F.concat(value, *[F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", i) for i in (2, 3)])
    return decode_attr_entities(value)


def _field(item: Column, spec: str | None) -> Column:
    """The text, or the attribute, of the first element that fits; the item itself where it fits."""
    if not spec:
        return F.lit(None).cast("string")
    selector, _, attribute = spec.partition("@")
    # What lies inside the item, without its own tag.
    inside = F.regexp_replace(item, r"^<[^>]*>", "")
    found = F.get(select(inside, selector), F.lit(0)) if selector else item
    if selector:
        found = F.coalesce(found, F.when(item.rlike(_start_pattern(selector.split()[-1])), item))
    return F.nullif(collapse_ws(_attribute(found, attribute) if attribute else _plain(found)), F.lit(""))


def normalize_html(pages: DataFrame, board: HtmlBoard) -> DataFrame:
    """B2: pages (provider, slug, page, url, html) to postings; links are made absolute, repeats within a board dropped."""
    html = F.coalesce("html", F.lit(""))
    jd = F.array_join(F.transform(select(html, board.jd), lambda x: F.btrim(_plain(x))), "\n\n") if board.jd else F.lit(None).cast("string")
    items = pages.select("provider", F.col("slug").alias("company_slug"), "page", "url", jd.alias("jd_text"), F.posexplode(select(html, board.item)).alias("pos", "item"))
    item = F.col("item")
    own = F.nullif(_attribute(item, board.id_attribute), F.lit("")) if board.id_attribute else F.lit(None).cast("string")
    found = items.select("provider", "company_slug", "page", "url", "pos", "jd_text", _field(item, board.title).alias("job_title"), _field(item, board.link).alias("link"), F.coalesce(_field(item, board.location), F.lit(board.fixed_location).cast("string")).alias("location"), own.alias("own_id"))
    if board.capture_title:
        found = found.withColumn("job_title", F.when(F.col("job_title").rlike(board.capture_title), F.btrim(F.regexp_extract("job_title", board.capture_title, 1))).otherwise(F.col("job_title")))
    found = found.where("job_title <> ''")
    if board.exclude_title:
        found = found.where(~F.col("job_title").rlike(board.exclude_title))
    origin, folder = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1), F.regexp_extract("url", r"^([a-z]+://[^?#]*/)", 1)
    link = F.when(F.col("link").rlike("^[a-z]+:"), F.col("link")).when(F.col("link").startswith("/"), F.concat(origin, F.col("link"))).otherwise(F.concat(folder, F.col("link")))
    named = found.withColumn("job_url", F.coalesce(link, "url")).withColumn("external_id", F.coalesce("own_id", board_external_id(link, F.col("job_title"), F.col("url"))))
    return first_per_key(named, ["provider", "company_slug", "external_id"], "page", "pos").select("provider", "company_slug", "external_id", "job_title", "job_url", "location", "jd_text")
