"""Page, url and text queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from corpusloom.functions import html, text as tx, urls
from corpusloom.operators import extract, sites
from corpusloom.plans.registry import query, quoted, table
from corpusloom.sources.tables import spread


NO_URL = "http://unknown.example/"


def pages(spark, sf):
    return spread(table(spark, sf, "pages"))


def sql_rules(column: str, rules) -> str:
    for pattern, new in rules:
        made = "E" + quoted(new.replace("\\", "\\\\").replace("$1", r"\\1").replace("\n", r"\n"))
        column = f"regexp_replace({column}, {quoted(pattern)}, {made}, 'g')"
    return column


def sql_unescape(column: str) -> str:
    for entity, char in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        column = f"replace({column}, {quoted(entity)}, {quoted(char)})"
    return column


# The twins have rules of their own, in the words of the page maker: they know the tags that the test pages use, all
# of them closed and without attributes that hold a sign of a tag.
SHOWN = sql_rules("html", [("(?s)<!--.*?-->", ""), ("(?s)<script[^>]*>.*?</script>", ""), ("(?s)<style[^>]*>.*?</style>", "")])
SQL_TITLE = sql_unescape(f"regexp_extract({SHOWN}, '(?s)<title>(.*?)</title>', 1)")
_PAGE_RULES = [
    ("(?s)^.*</head>", ""),
    (r"\s+", " "),
    ("</?(b|strong)>", "**"),
    ("</?(i|em|u)>", "_"),
    ("<br ?/?>", "  \n"),
    ("<li[^>]*>", "\n  * "),
    *((f"<h{n}[^>]*>", "\n\n" + "#" * n + " ") for n in range(1, 7)),
    ("<blockquote[^>]*>", "\n\n> "),
    ("<tr[^>]*>", "\n"),
    ("</t[dh]>", " | "),
    ("</?(p|div|article|section|header|footer|nav|main|aside|ul|ol|table|blockquote|h[1-6])( [^>]*)?>", "\n\n"),
    ("<[^>]+>", ""),
]
SQL_TEXT = sql_rules(sql_unescape(sql_rules(SHOWN, _PAGE_RULES)), [("\n([ \t]*\n)+", "\n\n"), ("^[ \n]+|[ \n]+$", "")])


def sql_safe(column: str) -> str:
    """Percent-encoding of a path: only characters outside the safe set are escaped."""
    column = f"url_encode({column})"
    for char in "/:?#[]@!$&()*+,;=%":
        column = f"replace({column}, '%{ord(char):02X}', {quoted(char)})"
    return f"replace({column}, '%27', '''')"


def sql_canonical(url: str) -> str:
    pairs = f"list_sort(list_filter(string_split(regexp_extract({url}, '\\?([^#]*)', 1), '&'), lambda p: p <> ''))"
    path = f"regexp_extract({url}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
    return (
        f"(lower(regexp_extract({url}, '^[a-z]+://[^/?#]*', 0)) || CASE WHEN {path} = '' THEN '/' ELSE {sql_safe(path)} END"
        f" || CASE WHEN len({pairs}) > 0 THEN '?' || array_to_string({pairs}, '&') ELSE '' END)"
    )


def sql_fingerprint(url: str) -> str:
    return f"sha1({sql_canonical(url)})"


SQL_SITE = "regexp_extract(lower(url), '^[a-z]+://(?:[^/?#]*\\.)?([^./?#:]+\\.[^./?#:]+)', 1)"
SQL_ORIGIN = "regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || '/'"
SQL_LINKS = f"""(SELECT DISTINCT url, {SQL_ORIGIN.replace("'/'", "''")} || {sql_unescape('href')} AS link FROM
    (SELECT url, unnest(regexp_extract_all({SHOWN}, '<a href="([^"]*)"', 1)) AS href FROM pages))"""


@query("page_items", f"SELECT url, {SQL_TITLE} AS title, '' AS description, '' AS keywords, {SQL_TEXT} AS content FROM pages")
def page_items(spark, sf):
    return extract.extract_items(pages(spark, sf))


@query("page_text", f"SELECT page_id, {SQL_TEXT} AS content FROM pages")
def page_text(spark, sf):
    return pages(spark, sf).select("page_id", html.html_to_text(F.col("html")).alias("content"))


@query(
    "page_meta",
    """SELECT page_id,
      CASE page_id % 2 WHEN 0 THEN 'page ' || page_id || ' & "' || split_part(url, '/', 3) || '"' ELSE '' END AS description,
      CASE page_id % 2 WHEN 1 THEN 'page ' || page_id || ' & "' || split_part(url, '/', 3) || '"' ELSE '' END AS keywords
    FROM pages""",
)
def page_meta(spark, sf):
    """Meta values; the pages carry none, so each gets a tag built from its own row."""
    tag = F.concat(
        F.lit('<meta NAME="'),
        F.when(F.col("page_id") % 2 == 0, "og:Description").otherwise("KEYWORDS"),
        F.lit("\" content='page "),
        F.col("page_id"),
        F.lit(' &amp; &#34;'),
        F.split_part("url", F.lit("/"), F.lit(3)),
        F.lit("&quot;'>"),
    )
    tagged = pages(spark, sf).withColumn("html", F.replace("html", F.lit("</head>"), F.concat(tag, F.lit("</head>"))))
    return tagged.select(
        "page_id",
        html.html_meta(F.col("html"), "description").alias("description"),
        html.html_meta(F.col("html"), "keywords").alias("keywords"),
    )


@query("url_fingerprint", f"SELECT page_id, {sql_canonical('url')} AS canonical, {sql_fingerprint('url')} AS fingerprint FROM pages")
def url_fingerprint(spark, sf):
    url = F.col("url")
    return pages(spark, sf).select(
        "page_id", urls.canonical_url(url).alias("canonical"), urls.url_fingerprint(url).alias("fingerprint")
    )


@query(
    "url_fingerprint_headers",
    f"SELECT page_id, sha1({sql_canonical('url')} || 'cookie' || page_id || 'x-lang' || regexp_extract(html, 'lang=\"([a-z]+)\"', 1)) AS fingerprint FROM pages",
)
def url_fingerprint_headers(spark, sf):
    headers = {"X-Lang": F.regexp_extract("html", 'lang="([a-z]+)"', 1), "Cookie": F.col("page_id").cast("string")}
    return pages(spark, sf).select("page_id", urls.url_fingerprint(F.col("url"), headers).alias("fingerprint"))


@query("site_of_url", f"SELECT page_id, {SQL_SITE} AS site, {SQL_ORIGIN} AS origin FROM pages")
def site_of_url(spark, sf):
    url = F.col("url")
    return pages(spark, sf).select(
        "page_id", urls.registered_domain(url).alias("site"), urls.url_origin(url).alias("origin")
    )


_SUFFIX_RULES = ["com", "net", "org", "example.net", "*.example.org", "!thther.example.org"]
_HOST = "string_split(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '.')"


@query(
    "site_by_suffix_table",
    f"""SELECT page_id, CASE WHEN h[-1] = 'com' OR array_to_string(h[-3:], '.') = 'thther.example.org' THEN array_to_string(h[-(CASE h[-1] WHEN 'com' THEN 2 ELSE 3 END):], '.')
      WHEN h[-1] = 'net' THEN array_to_string(h[-3:], '.') ELSE array_to_string(h[-4:], '.') END AS site
    FROM (SELECT page_id, {_HOST} AS h FROM pages)""",
)
def site_by_suffix_table(spark, sf):
    """Sites by a table of public suffixes with a wildcard and an exception."""
    rules = spark.createDataFrame([(r,) for r in _SUFFIX_RULES], "suffix string")
    return sites.site_by_rules(pages(spark, sf), rules).select("page_id", "site")


@query(
    "allowed_domains",
    "SELECT page_id FROM pages WHERE regexp_matches(url, '^[a-z]+://([^/]*\\.)?example\\.(com|org)([/?#:]|$)')",
)
def allowed_domains(spark, sf):
    return pages(spark, sf).filter(urls.allowed_host(F.col("url"), "example.com,,example.org")).select("page_id")


@query("same_site_links", f"SELECT url, link FROM {SQL_LINKS}")
def same_site_links(spark, sf):
    """Links of every url; of several pages with one url each link counts once."""
    return extract.same_site_links(pages(spark, sf)).select("url", "link").distinct()


@query(
    "page_links_quoted",
    """SELECT page_id, unnest([split_part(url, '?', 1) || '#"' || page_id, 'next=' || page_id, 'bare' || page_id]) AS link FROM pages""",
)
def page_links_quoted(spark, sf):
    """Links of tags whose other attributes hold the words of a link in their quoted values, and of one unquoted."""
    number = F.col("page_id").cast("string")
    tags = F.concat(
        F.lit("<a title=\"see href=wrong\" data-href='no' HREF = '"),
        F.split_part("url", F.lit("?"), F.lit(1)),
        F.lit("#&quot;"),
        number,
        F.lit("'>x</a><a class='href=\"no\"' href=\"next="),
        number,
        F.lit("\">y</a><a href=bare"),
        number,
        F.lit(" title='>'>z</a><!-- <a href='gone'> --><script>'<a href=gone>'"),
    )
    return pages(spark, sf).select("page_id", F.explode(html.html_hrefs(tags)).alias("link"))


@query(
    "document_ids",
    f"""WITH d AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url END AS url,
      CASE WHEN page_id % 3 = 1 THEN 'c' || page_id END AS code, {SQL_TITLE} AS title FROM pages)
    SELECT page_id, coalesce(CASE WHEN url IS NOT NULL THEN {sql_fingerprint('url')} END, code, md5(title || 'k')) AS _id,
      CASE WHEN url IS NULL AND code IS NULL THEN {quoted(NO_URL)} ELSE url END AS url FROM d""",
)
def document_ids(spark, sf):
    """A third of the pages keeps its url, a third has a code, a third neither."""
    rest = F.col("page_id") % 3
    docs = pages(spark, sf).select(
        "page_id",
        F.when(rest == 0, F.col("url")).alias("url"),
        F.when(rest == 1, F.concat(F.lit("c"), F.col("page_id"))).alias("code"),
        html.html_title(F.col("html")).alias("title"),
    )
    url, code = F.col("url"), F.col("code")
    return docs.select(
        "page_id",
        urls.document_id(url, code, F.col("title"), F.lit("k")).alias("_id"),
        urls.document_url(url, code, NO_URL).alias("url"),
    )


_STYLED = "'## ' || source || ' _head_' || chr(10) || '* see [the **label**](http://x.y/' || doc_id || ') ![alt](i.png)' || chr(10) || chr(10) || chr(10) || '> `code` <b>bold</b> &amp; ' || text"
# The twin's rules name the marks that stand around the documents and those that their texts may have.
_MARK_RULES = [
    (r"!\[alt\]\(i\.png\)", ""),
    (r"\[([^\[\]]*)\]\([^()]*\)", "$1"),
    (r"(?m)^[ \t]*([-*_][ \t]*){3,}$", ""),
    (r"(?m)^ {0,3}#{1,6}[ \t]+(.*?)[ \t#]*$", "$1"),
    (r"(?m)^[ \t]*>[ \t]?", ""),
    (r"(?m)^[ \t]*([-*+]|[0-9]+\.)[ \t]+", ""),
    (r"\*\*([^*\n]+)\*\*", "$1"),
    (r"__([^_\n]+)__", "$1"),
    (r"\*([^*\s][^*\n]*)\*", "$1"),
    (r"\b_([^_\n]+)_\b", "$1"),
    ("`([^`]*)`", "$1"),
    ("</?[a-z][^<>]*>", ""),
]
_PLAIN = sql_unescape(sql_rules(_STYLED, _MARK_RULES))


def styled(spark, sf):
    """Documents as Markdown: marks around each document's own values and text."""
    return spread(table(spark, sf, "documents")).select("doc_id", F.expr(_STYLED.replace("chr(10)", "char(10)")).alias("text"))


@query("clean_style", f"SELECT doc_id, {_PLAIN} AS text FROM documents")
def clean_style(spark, sf):
    return styled(spark, sf).select("doc_id", tx.remove_style(F.col("text")).alias("text"))


_FULLY = sql_unescape(sql_rules(sql_rules(_STYLED, [(r"!?\[[^\[\]]*\]\([^()]*\)", "")]), _MARK_RULES))


@query("clean_style_fully", f"SELECT doc_id, regexp_replace({_FULLY}, '\\n+', chr(10), 'g') AS text FROM documents")
def clean_style_fully(spark, sf):
    return styled(spark, sf).select("doc_id", tx.remove_style_fully(F.col("text")).alias("text"))


@query(
    "clean_style_junk",
    """SELECT doc_id, repeat('[a ', 300) || chr(10) || chr(10) || repeat('<!- a ', 300) || text || chr(10) || 'end' AS text
    FROM (SELECT doc_id, source AS text FROM documents)""",
)
def clean_style_junk(spark, sf):
    """Runs of opened marks that are never closed stay; a rule of very many signs goes."""
    junk = F.concat(
        F.repeat(F.lit("[a "), 300),
        F.lit("\n"),
        F.repeat(F.lit("- "), 5000),
        F.lit("\n"),
        F.repeat(F.lit("<!- a "), 300),
        F.col("source"),
        F.lit("\n## end ##"),
    )
    return table(spark, sf, "documents").select("doc_id", tx.remove_style(junk).alias("text"))


@query(
    "map_lines",
    "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l: '> ' || lower(trim(l, ' '))), chr(10)) AS text FROM documents",
)
def map_lines(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", tx.map_lines(F.col("text"), lambda line: F.concat(F.lit("> "), F.lower(F.trim(line)))).alias("text")
    )


@query(
    "translate_terms",
    f"""WITH dict AS (SELECT DISTINCT lower(p_name) AS source, p_brand AS target FROM (
        SELECT split_part(p_name, ' ', 1) AS p_name, min(p_brand) AS p_brand FROM part GROUP BY 1)),
    w AS (SELECT p_partkey, pos, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word,
        unnest(range(len(string_split(p_name, ' ')))) AS pos FROM part))
    SELECT p_partkey, CAST(pos AS INTEGER) AS pos, coalesce(target, word) AS word FROM w LEFT JOIN dict ON lower(word) = source""",
)
def translate_terms(spark, sf):
    part = table(spark, sf, "part")
    dictionary = part.groupBy(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("source")).agg(
        F.min("p_brand").alias("target")
    )
    return extract.translate_terms(part.select("p_partkey", "p_name"), "p_name", dictionary).select("p_partkey", "pos", "word")


@query(
    "english_only",
    "SELECT p_partkey, p_type, regexp_matches(p_type, '^[a-zA-Z]+$') AS whole, regexp_matches(p_brand, '^[a-zA-Z]+$') AS brand FROM part",
)
def english_only(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", "p_type", tx.is_english(F.col("p_type")).alias("whole"), tx.is_english(F.col("p_brand")).alias("brand")
    )


@query(
    "almost_same",
    """SELECT p_partkey, lower(replace(p_name, ' ', '')) = lower(regexp_replace(p_brand, '[^0-9A-Za-z_]', '', 'g')) AS brand,
      true AS shouted FROM part""",
)
def almost_same(spark, sf):
    name = F.col("p_name")
    shouted = F.upper(F.replace(name, F.lit(" "), F.lit(" - ")))
    return table(spark, sf, "part").select(
        "p_partkey",
        tx.almost_same(name, F.col("p_brand")).alias("brand"),
        tx.almost_same(name, shouted).alias("shouted"),
    )


_LETTERS, _SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黄"


@query(
    "questions",
    f"""WITH c AS (SELECT c_custkey, translate(c_mktsegment, '{_LETTERS}', '{_SIGNS}') || CASE WHEN c_nationkey < 12 THEN '?' ELSE '' END AS title,
      c_name || ' ' || translate(c_mktsegment, '{_LETTERS}', '{_SIGNS}') || '?' || chr(10) || '?' AS description FROM customer)
    SELECT c_custkey, unnest(list_filter(list_concat([title], regexp_split_to_array(description, '\\s+')),
      lambda x: regexp_matches(x, '^[一-龥]+\\?$'))) AS value FROM c""",
)
def questions(spark, sf):
    """Market segments spelled in CJK signs stand for titles and descriptions."""
    signs = F.translate("c_mktsegment", _LETTERS, _SIGNS)
    title = F.concat(signs, F.when(F.col("c_nationkey") < 12, "?").otherwise(""))
    description = F.concat(F.col("c_name"), F.lit(" "), signs, F.lit("?\n?"))
    return table(spark, sf, "customer").select("c_custkey", F.explode(tx.questions(title, description)).alias("value"))


@query(
    "first_values",
    """SELECT p_partkey, coalesce(nullif(trim(split_part(p_brand, '#', 3)), ''), nullif(trim(split_part(p_name, ' ', 2)), ''), p_type) AS value FROM part""",
)
def first_values(spark, sf):
    third = F.concat(F.lit("  "), F.split_part("p_brand", F.lit("#"), F.lit(3)))
    values = F.array(third, F.concat(F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" ")), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", tx.first_value(values).alias("value"))
