"""HTML columns: title, meta values, links and text, all as built-in expressions.

Quantified groups are possessive, so that a long page neither backtracks nor
deepens the matcher's stack, and no pattern reads on to the end of the page and
then fails: an unclosed comment, script or head goes to the end, and a tag ends
before the next ``<`` outside its quoted values.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.binding import let

_UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*+(?:>.*?(?:</\1\s*+>|\z)|\z)"
_INSIDE = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""
_ATTRIBUTE = r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'<>]++))?+"""
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"

_NAMED = {**{name: chr(point) for name, point in name2codepoint.items()}, "apos": "'"}


def visible(html: Column) -> Column:
    """The page without comments, scripts and style sheets."""
    return F.regexp_replace(html, _UNSEEN, "")


def _character(entity: Column) -> Column:
    """The character of a numeric reference, null for another entity."""
    digits = F.regexp_extract(entity, "^&#[xX]?([0-9a-fA-F]+);$", 1)
    point = F.when(entity.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")

    def encode(number: Column) -> Column:
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        return F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number)), 8, "0")), "UTF-32")

    return F.when(entity.startswith("&#"), F.coalesce(let(point, encode), F.lit("\ufffd")))


def unescape(text: Column) -> Column:
    """Named and numeric character references decoded; unknown ones stay."""
    # one foldable expression instead of a literal per entry keeps plans small
    names = F.from_json(F.lit(json.dumps(_NAMED)), "map<string,string>")

    def plain(entity: Column) -> Column:
        named = F.try_element_at(names, F.regexp_replace(entity, "[&;]", ""))
        return F.coalesce(_character(entity), named, entity)

    def decode(source: Column) -> Column:
        found = F.transform(F.regexp_extract_all(source, F.lit(_ENTITY), F.lit(0)), plain)
        pieces = F.zip_with(
            F.split(source, _ENTITY, -1), found, lambda piece, char: F.concat(piece, F.coalesce(char, F.lit("")))
        )
        return F.when(source.contains("&"), F.array_join(pieces, "")).otherwise(source)

    return let(text, decode)


def attribute(tag: Column, name: str) -> Column:
    """Decoded value of the first attribute of that name of one start tag, '' if it has none.

    The tag is cut into its attributes in order, so a name inside a quoted value is no attribute.
    """
    body = F.regexp_replace(tag, r"^<[a-zA-Z][^\s/>]*+", "")
    names = F.regexp_extract_all(F.lower(body), F.lit(_ATTRIBUTE), F.lit(1))
    values = F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(2))
    value = let(values, lambda v: F.coalesce(F.get(v, F.array_position(names, F.lit(name)).cast("int") - 1), F.lit("")))
    return unescape(F.regexp_replace(value, "^[\"']|[\"']$", ""))


def _title(shown: Column) -> Column:
    inner = F.regexp_extract(shown, r"(?is)<title\b[^<>]*+>(.*?)(?:</title\s*+>|\z)", 1)
    return F.coalesce(unescape(inner), F.lit(""))


def _metas(shown: Column) -> Column:
    """All meta tags that have a content, as ``struct<name, content>``."""
    tags = F.regexp_extract_all(shown, F.lit(rf"(?is)<meta\b{_INSIDE}>"), F.lit(0))
    filled = F.filter(tags, lambda tag: tag.rlike(r"(?is)[\s\"'/]content\s*="))
    return F.transform(
        filled,
        lambda tag: F.struct(
            F.lower(attribute(tag, "name")).alias("name"), attribute(tag, "content").alias("content")
        ),
    )


def _meta(metas: Column, name: str) -> Column:
    fits = F.filter(metas, lambda m: m["name"].contains(name.lower()))
    return F.coalesce(F.get(fits, F.lit(0))["content"], F.lit(""))


def html_title(html: Column) -> Column:
    """Text of the first title, '' if there is none."""
    return _title(visible(html))


def html_meta(html: Column, name: str) -> Column:
    """``content`` of the first meta tag whose lower-cased name contains ``name``, else ''."""
    return let(_metas(visible(html)), lambda metas: _meta(metas, name))


def html_hrefs(html: Column) -> Column:
    """Distinct values of every href attribute, in page order."""
    tags = F.regexp_extract_all(visible(html), F.lit(rf"(?is)<[a-z]{_INSIDE}>"), F.lit(0))
    linked = F.filter(tags, lambda tag: tag.rlike(r"(?is)[\s\"'/]href\s*="))
    return F.array_distinct(F.transform(linked, lambda tag: F.trim(attribute(tag, "href"))))


_BLOCKS = "h[1-6]|blockquote|p|div|article|section|header|footer|nav|main|aside|ul|ol|dl|dt|dd|table|form|pre|title"
_LAYOUT = [
    (r"(?is)<head\b[^>]*+(?:>.*?(?:</head\s*+>|(?=<body\b)|\z)|\z)", ""),
    (r"\s{2,}|[\t\n\r\f]", " "),
    (r"(?i)<h([1-6])\b[^<>]*+>", "\n\n\u0001$1 "),
    (r"(?i)</?(?:b|strong)(?:\s[^<>]*+)?+>", "**"),
    (r"(?i)</?(?:i|em|u)(?:\s[^<>]*+)?+>", "_"),
    (r"(?i)<br\b[^<>]*+>", "  \n"),
    (r"(?i)<hr\b[^<>]*+>", "\n\n* * *\n\n"),
    (r"(?i)<li\b[^<>]*+>", "\n  * "),
    (r"(?i)<blockquote\b[^<>]*+>", "\n\n> "),
    (r"(?i)<tr\b[^<>]*+>", "\n"),
    (r"(?i)</t[dh]\s*+>", " | "),
    (rf"(?i)</?(?:{_BLOCKS})(?:\s[^<>]*+)?+>", "\n\n"),
    (r"<[/!?a-zA-Z][^<>]*+>", ""),
]
# Heading levels pass through the tag rules as a sign and a digit.
_HEADINGS = {f"\u0001{level}": "#" * level for level in range(1, 7)}


# White space of preformatted text passes through the rules as other signs.
_PRE_SPACE, _PRE_SIGNS = "\n\t ", "\u0002\u0003\u0004"


def _hold_pre(shown: Column) -> Column:
    """Preformatted parts with signs for their white space; an unclosed one goes to the end."""
    end = r"(?is)</pre\s*+>"

    def part(piece: Column, i: Column) -> Column:
        inner = F.get(F.split(piece, end, 2), F.lit(0))
        held = F.concat(F.translate(F.regexp_replace(inner, "\r\n?", "\n"), _PRE_SPACE, _PRE_SIGNS), F.substr(piece, F.length(inner) + 1))
        return F.when(i == 0, piece).otherwise(F.concat(F.lit("<pre>"), held))

    pieces = F.transform(F.split(shown, r"(?i)<pre\b[^<>]*+>", -1), part)
    return F.when(F.lower(shown).contains("<pre"), F.array_join(pieces, "")).otherwise(shown)


def _text(shown: Column) -> Column:
    shown = let(shown, _hold_pre)
    for pattern, new in _LAYOUT:
        shown = F.regexp_replace(shown, pattern, new)
    for sign, marks in _HEADINGS.items():
        shown = F.replace(shown, F.lit(sign), F.lit(marks))
    text = F.btrim(F.regexp_replace(unescape(shown), r"\n(?:[ \t]*+\n)++", "\n\n"), F.lit(" \n"))
    # bound, as each mention of the text inside an expression would run all rules anew
    return let(text, lambda t: F.when(t.contains(_PRE_SIGNS[0]) | t.contains(_PRE_SIGNS[2]) | t.contains(_PRE_SIGNS[1]), F.translate(t, _PRE_SIGNS, _PRE_SPACE)).otherwise(t))


def html_to_text(html: Column) -> Column:
    """Page body as Markdown-like text: marks for headings, lists and emphasis, links dropped."""
    return _text(visible(html))


def item(html: Column) -> Column:
    """``struct<title, description, keywords, content>`` from one cleaning of the page."""

    def parts(shown: Column) -> Column:
        return let(
            _metas(shown),
            lambda metas: F.struct(
                _title(shown).alias("title"),
                _meta(metas, "description").alias("description"),
                _meta(metas, "keywords").alias("keywords"),
                _text(shown).alias("content"),
            ),
        )

    return let(visible(html), parts)
