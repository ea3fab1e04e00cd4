"""Text functions, all of native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named entities and what they stand for, in the order in which they are replaced.
ENTITIES = (
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "),
    ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&rdquo;", "”"), ("&ldquo;", "“"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"),
)
# The named entities of attribute values.
ATTRIBUTE_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
# Legal forms that end a company's name.
LEGAL_SUFFIXES = ("pvt", "private", "ltd", "limited", "inc", "llc", "corp", "corporation")


def collapse_ws(c: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.btrim(F.regexp_replace(c, r"[\s ]+", " "))


def _code_point(number: Column, entity: Column) -> Column:
    """The character of a code point, UTF-8 bytes put together; anything that is none stays as written."""
    n = number

    def byte(x: Column) -> Column:
        return F.lpad(F.hex(x.cast("long")), 2, "0")

    tail = lambda k: F.lit(0x80).bitwiseOR(F.shiftrightunsigned(n, k).bitwiseAND(F.lit(0x3F)))
    encoded = (
        F.when(n < 0x80, byte(n))
        .when(n < 0x800, F.concat(byte(F.lit(0xC0).bitwiseOR(F.shiftrightunsigned(n, 6))), byte(tail(0))))
        .when(n < 0x10000, F.concat(byte(F.lit(0xE0).bitwiseOR(F.shiftrightunsigned(n, 12))), byte(tail(6)), byte(tail(0))))
        .otherwise(F.concat(byte(F.lit(0xF0).bitwiseOR(F.shiftrightunsigned(n, 18))), byte(tail(12)), byte(tail(6)), byte(tail(0))))
    )
    whole = n.isNotNull() & (n >= 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(whole, F.decode(F.unhex(encoded), "UTF-8")).otherwise(entity)


def _replace_matches(c: Column, pattern: str, change) -> Column:
    """Each match of a pattern changed by a column function; what lies between is kept."""
    between = F.split(c, pattern, -1)
    found = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), change)
    woven = F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(c.rlike(pattern), F.array_join(woven, "")).otherwise(c)


def _number(entity: Column) -> Column:
    digits = F.regexp_extract(entity, r"&#(\d{1,9});", 1)
    hexadecimal = F.regexp_extract(entity, r"(?i)&#x([0-9a-f]{1,8});", 1)
    return F.when(digits != "", digits.cast("long")).when(hexadecimal != "", F.conv(hexadecimal, 16, 10).cast("long"))


def decode_numeric_entities(c: Column) -> Column:
    return _replace_matches(c, r"(?i)&#(?:\d+|x[0-9a-f]+);", lambda e: _code_point(_number(e), e))


def decode_attr_entities(c: Column) -> Column:
    """One layer of attribute escaping; unknown names stay."""
    names = F.create_map(*[F.lit(x) for pair in ATTRIBUTE_ENTITIES.items() for x in pair])
    return _replace_matches(c, r"&(?:#\d+|#[xX][0-9a-fA-F]+|[a-zA-Z]+);", lambda e: F.coalesce(F.when(F.startswith(e, F.lit("&#")), _code_point(_number(e), e)), F.try_element_at(names, F.regexp_extract(e, r"&([a-zA-Z]+);", 1)), e))


def html_to_text(c: Column) -> Column:
    """Visible text of a fragment; null gives an empty text."""
    s = F.coalesce(c, F.lit(""))
    escaped = ~s.rlike(r"(?i)<[a-z!/]") & s.rlike(r"(?i)&lt;\s*/?[a-z][a-z0-9-]*[\s/&>]")
    s = F.when(escaped, decode_attr_entities(s)).otherwise(s)
    s = F.regexp_replace(s, r"(?is)<(script|style)\b.*?</\1>", "")
    s = F.regexp_replace(s, r"(?i)</(p|div|li|h[1-6]|br|tr|td)\s*>", "\n")
    s = F.regexp_replace(s, r"(?i)<br\s*/?>", "\n")
    s = F.regexp_replace(s, r"<[^>]+>", "")
    for entity, plain in ENTITIES:
        s = F.replace(s, F.lit(entity), F.lit(plain))
    s = decode_numeric_entities(s)
    s = F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r"\n[ \t]*\n[ \t]*\n+", "\n\n")
    return F.regexp_replace(s, r"^[\s ]+|[\s ]+\z", "")


def join_location(*parts: Column) -> Column:
    """C4: non-blank parts, trimmed, joined by a comma; null if none is left."""
    trimmed = F.filter(F.transform(F.array(*parts), lambda p: F.btrim(p)), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.size(trimmed) > 0, F.array_join(trimmed, ", "))


def is_remote(c: Column) -> Column:
    """C5."""
    return F.coalesce(c.rlike(r"(?i)\b(remote|work from home|wfh|anywhere|virtual)\b"), F.lit(False))


def kebab_case(c: Column) -> Column:
    """C10."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def resolve_slug(slug: Column, name: Column) -> Column:
    """The slug given, or the name in kebab case."""
    return F.when(F.length(slug) > 0, slug).otherwise(kebab_case(name))


def registry_key(source: Column, slug: Column, name: Column) -> Column:
    """C10."""
    return F.concat(F.coalesce(source, F.lit("custom")), F.lit("::"), resolve_slug(slug, name))


def slug_variants(name: Column) -> Column:
    """C11: likely slugs of a company: kebab, flat, without its legal form, without a leading `the`."""
    kebab = kebab_case(name)
    bare = F.regexp_replace(kebab, r"-(" + "|".join(LEGAL_SUFFIXES) + r")$", "")
    return F.array_distinct(F.filter(F.array(kebab, F.replace(kebab, F.lit("-"), F.lit("")), bare, F.replace(bare, F.lit("-"), F.lit("")), F.regexp_replace(kebab, "^the-", "")), lambda x: F.length(x) > 1))


def normalize_company_name(c: Column) -> Column:
    """Lower case, punctuation to spaces, legal forms at the end dropped while a word is left."""
    plain = collapse_ws(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", " "))
    return F.regexp_replace(plain, r"(?<=\S)(\s+(" + "|".join(LEGAL_SUFFIXES) + r"))+$", "")


def domain_label(email: Column) -> Column:
    """C14: first label of the domain after the last @; null without one."""
    label = F.lower(F.regexp_extract(email, r"@([^@.]+)[^@]*$", 1))
    return F.when(label != "", label)


def valid_email(c: Column) -> Column:
    """C15."""
    return F.coalesce(c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False))


def split_emails(cell: Column) -> Column:
    """Addresses of a cell, lower-cased, valid ones only."""
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), r"[/,]"), lambda x: F.lower(F.btrim(x))), valid_email)


def is_no_reply(c: Column) -> Column:
    """C15."""
    return F.coalesce(c.rlike(r"(?i)^(no-?reply|do-?not-?reply|donotreply)@"), F.lit(False))


def notify_key(company: Column, title: Column, location: Column) -> Column:
    """Identity of a role across repostings."""
    return F.concat_ws("|", *[collapse_ws(F.lower(F.coalesce(c, F.lit("")))) for c in (company, title, location)])


def first_name(c: Column) -> Column:
    """C17: first word of a name, else `there`."""
    word = F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(\S+)", 1)
    return F.when(word != "", word).otherwise("there")


def company_for_mention(c: Column) -> Column:
    """C17: the name where it reads well in a sentence, else null."""
    name = F.btrim(F.split_part(c, F.lit("|"), F.lit(1)))
    return F.when(F.length(name).between(3, 60) & ~name.rlike(r"(?i)^(\(|(a|an|the)\s)") & name.rlike("[a-zA-Z]") & ~name.rlike("(?i)unknown"), name)


def role_summary(titles: Column) -> Column:
    """C17: the first role, and how many more."""
    n = F.size(titles)
    return F.when(n == 1, titles[0]).when(n > 1, F.concat(titles[0], F.lit(" and "), (n - 1).cast("string"), F.lit(" more")))


def compile_template(text: str, **columns: Column) -> Column:
    """A template with {{name}} places as one expression; a place without a column is an error."""
    import re

    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", text)
    missing = sorted({p for p in parts[1::2] if p not in columns})
    if missing:
        raise ValueError(f"no value for {', '.join(missing)}")
    return F.concat(*[F.coalesce(columns[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def bullet_lines(values: Column) -> Column:
    """A list as lines that start with a dash."""
    return F.array_join(F.transform(values, lambda v: F.concat(F.lit("- "), v)), "\n")


def stable_hash(c: Column) -> Column:
    """C20: 32-bit FNV-1a over UTF-16 units of text in the basic plane, in base 36."""
    units = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    value = F.aggregate(units, F.lit(0x811C9DC5).cast("long"), lambda h, u: (h.bitwiseXOR(u) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.conv(value.cast("string"), 10, 36))


def url_path_text(url: Column) -> Column:
    """The path as words: separators to spaces, lower case; a url that does not parse is taken whole."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), url)
    return F.lower(F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path), r"[-_/.+]", " "))


def title_from_url(url: Column) -> Column:
    """A title from the last segment of a path, `(position)` where nothing is left."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.lit("")).otherwise(url)), r"/+$", "")
    last = F.element_at(F.split(path, "/"), -1)
    plain = F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last), r"(?i)\.(html|aspx|php)$", "")
    words = collapse_ws(F.regexp_replace(F.regexp_replace(plain, r"[-_]+", " "), r"\b\d{4,}\b", " "))
    return F.when(words == "", F.lit("(position)")).otherwise(F.btrim(F.substring(F.initcap(words), 1, 140)))


def title_from_sitemap_url(url: Column) -> Column:
    """A title from the path's last segment but one (its only one), words in upper case first; `Untitled role` without one."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.lit("")).otherwise(url))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    chosen = F.coalesce(F.get(segments, F.when(F.size(segments) >= 2, F.size(segments) - 2).otherwise(0)), F.lit(""))
    words = F.filter(F.split(F.coalesce(F.try_url_decode(F.replace(chosen, F.lit("+"), F.lit("%2B"))), chosen), "[-_]+"), lambda x: x != "")
    named = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")
    return F.when(F.size(words) == 0, F.lit("Untitled role")).otherwise(named)


def normalize_lines(c: Column) -> Column:
    """Line ends, spaces at line ends, at most one blank line."""
    s = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t]+(?=\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(s, r"\n{3,}", "\n\n"), r"^\s+|\s+\z", "")


def parse_api_meta(c: Column) -> Column:
    """A JSON object of strings; null where it is not one."""
    return F.when(F.try_parse_json(c).isNotNull() & F.btrim(c).startswith("{"), F.from_json(c, "map<string,string>"))


def dig(json: Column, path: str, kind: str = "string") -> Column:
    """The value at a dotted path (numbers index arrays); null where the way ends early."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split(".") if p)
    return F.try_variant_get(F.try_parse_json(json), "$" + steps, kind)


ROLES = "array<struct<title:string,jobUrl:string,severity:string,score:double>>"


def parse_roles(c: Column) -> Column:
    """Role list of a JSON text; empty where it is none."""
    return F.coalesce(F.from_json(c, ROLES), F.array().cast(ROLES))


def location_hierarchy(full: Column, short: Column) -> Column:
    """Parts of a `>` chain, first spelling of each kept; the short form stands first where it adds something."""
    parts = F.filter(F.transform(F.split(F.coalesce(full, F.lit("")), ">"), lambda x: F.btrim(x)), lambda x: x != "")
    unique = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))
    own = F.filter(F.transform(F.split(F.coalesce(short, F.lit("")), ">"), lambda x: F.btrim(x)), lambda x: x != "")
    adds = F.exists(own, lambda x: ~F.exists(unique, lambda y: F.lower(y) == F.lower(x)))
    joined = F.array_join(F.when(adds, F.concat(F.array(F.array_join(own, ", ")), unique)).otherwise(unique), ", ")
    return F.when(joined != "", joined)


def location_from_text(jd: Column) -> Column:
    """What follows `Location:`, up to 60 characters, a line's end, a tag, comma, semicolon or bar."""
    found = F.btrim(F.regexp_extract(jd, r"(?i)\blocation\s*:\s*([^\n<,;|]{2,60})", 1))
    return F.when(found != "", found)


def folded(c: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(c), "àáâãäåāăąçćčďèéêëēėęěğìíîïīįłñńňòóôõöōőøřśşšťùúûüūůűýÿźżž", "aaaaaaaaacccdeeeeeeeegiiiiiilnnnoooooooorssstuuuuuuuyyzzz")


# Codes of North American regions; those that also are codes of other places are left out.
REGION_CODES = (
    "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TX|UT|VT|VA|WA|WV|WI|WY|ON|BC|AB|QC|MB|NS|NB|PE"
)


def is_place_in_region(c: Column, country: str, iso: str, places: list[str], guards: list[str], codes: str = REGION_CODES) -> Column:
    """The country as a word, its ISO code as a segment, or a known place that no guard word, region code or ZIP code belies."""
    plain = F.concat(F.lit(" "), F.btrim(F.regexp_replace(folded(c), "[^a-z0-9]+", " ")), F.lit(" "))
    word = lambda items: r" (?:" + "|".join(items) + r") " if items else r"(?!)"
    named = F.exists(F.split(F.lower(c), r"[,\-\s.()/|;_]+"), lambda x: x == country.lower())
    coded = c.rlike(rf"(?i)^\s*{iso}\b") | c.rlike(rf"\b{iso}\s*$|[-,(]\s*{iso}\b")
    away = c.rlike(r"\b[A-Z]{2}\s+\d{5}\b") | c.rlike(rf",\s*(?:{codes})\b|\s(?:{codes})\s*$")
    return F.coalesce(named | coded | (~away & plain.rlike(word(places)) & ~plain.rlike(word(guards))), F.lit(False))
