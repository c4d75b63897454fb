"""Column functions on literal cases."""

from __future__ import annotations

import hashlib
import html as stdhtml
import random
import re
import time
from fnmatch import fnmatchcase
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import geo, html, strings, text as tx, urls


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_permuted_query_has_one_fingerprint(spark):
    rows = [("http://www.example.com/query?id=111&cat=222",), ("http://www.Example.com/query?cat=222&id=111#top",)]
    prints = {r[0] for r in values(spark, rows, "u string", urls.url_fingerprint(F.col("u")))}
    assert prints == {hashlib.sha1(b"http://www.example.com/query?cat=222&id=111").hexdigest()}


def test_canonical_url(spark):
    cases = {
        "HTTP://A.Com": "http://a.com/",
        "http://a.com:/x": "http://a.com/x",
        "http://a.com/a b%7e%2f+?q=x+y&b=&c=%C3%A9*": "http://a.com/a%20b~%2F+?b=&c=%C3%A9%2A&q=x+y",
        "http://a.com/%zz?%zz": "http://a.com/%zz?%25zz=",
        "http://a.com/?b=2&a=3&a=1": "http://a.com/?a=1&a=3&b=2",
    }
    got = values(spark, [(u,) for u in cases], "u string", "u", urls.canonical_url(F.col("u")))
    assert dict(got) == cases


def test_fingerprint_headers_are_optional_and_ordered(spark):
    a = urls.url_fingerprint(F.lit("http://a.com/"), {"B": F.lit("2"), "a": F.lit("1"), "c": F.lit(None).cast("string")})
    assert values(spark, [(1,)], "x int", a)[0][0] == hashlib.sha1(b"http://a.com/a1b2").hexdigest()


def test_registered_domain(spark):
    cases = {
        "http://www.a.co.uk/x": "a.co.uk",
        "https://x.y.example.com:80/": "example.com",
        "http://10.0.0.1/": "10.0.0.1",
        "http://localhost/": "localhost",
        "http://me@news.b.com.cn": "b.com.cn",
    }
    got = values(spark, [(u,) for u in cases], "u string", "u", urls.registered_domain(F.col("u")))
    assert dict(got) == cases


def test_resolve_like_the_standard_library(spark):
    hrefs = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "", "..", "../", "../g", "../../../g", "http://x.y/z", ".", "a/../b"]
    bases = ["http://a.com/b/c/d?p#q", "http://a.com", "https://a.com/x/"]
    rows = [(b, h) for b in bases for h in hrefs]
    for base, href, made in values(spark, rows, "b string, h string", "b", "h", urls.resolve(F.col("b"), F.col("h"))):
        wanted = urljoin(base, href)
        if not href and base.endswith("#q"):
            wanted = base[:-2]  # an empty link drops the fragment here
        assert made == wanted, (base, href)


PAGE = """<html><head><title>A &amp; B &#x4e00;&#66;</title><!-- <title>no</title> -->
<META name="X-Description" content='say "hi" > now'><meta name=keywords content=k1></head>
<body><script>var t="<a href='/no'>"</script><h2>Top</h2><p>One <b>two</b> <i>three</i></p><ul><li>x</li></ul>
<a href="../up?a=1&amp;b=2">up</a><a HREF='http://other.org/'>o</a><a href=/abs>z</a></body></html>"""


def test_page_parts(spark):
    page = F.col("h")
    row = values(
        spark, [(PAGE,)], "h string", html.html_title(page), html.html_meta(page, "description"),
        html.html_meta(page, "keywords"), html.html_hrefs(page), html.html_to_text(page),
    )[0]
    assert row[0] == "A & B 一B"
    assert row[1] == 'say "hi" > now'
    assert row[2] == "k1"
    assert row[3] == ["../up?a=1&b=2", "http://other.org/", "/abs"]
    assert row[4].startswith("## Top\n\nOne **two** _three_\n\n  * x") and "var t" not in row[4]


def test_page_without_parts(spark):
    row = values(spark, [("<p>x",)], "h string", html.html_title(F.col("h")), html.html_meta(F.col("h"), "keywords"))[0]
    assert row == ("", "")


def test_long_pages_do_not_exhaust_the_stack(spark):
    page = "<p>" + "\n <br> \n" * 20000 + "<meta " + "a='b' " * 20000 + ">" + "<a href='/x'>" * 5000
    row = values(spark, [(page,)], "h string", F.length(html.html_to_text(F.col("h"))), F.size(html.html_hrefs(F.col("h"))))[0]
    assert row[1] == 1


def test_unescape_like_the_standard_library(spark):
    cases = ["&lt;&gt;", "&eacute;&Omega;", "&#65;&#x1F600;", "&unknown; &", "a && b &amp;amp;", ""]
    got = values(spark, [(c,) for c in cases], "t string", "t", html.unescape(F.col("t")))
    for source, made in got:
        assert made == (stdhtml.unescape(source) if "unknown" not in source else source)


def test_analyzer_positions_and_dictionary(spark):
    text = "The Cats 药品和医院 R2"
    row = values(
        spark, [(text,)], "t string", tx.terms(F.col("t")), tx.terms(F.col("t"), dictionary=["医院", "药品"]),
        tx.positioned_terms(F.col("t")),
    )[0]
    assert row[0] == ["cats", "药", "品", "医", "院", "r2"]
    assert row[1] == ["cats", "医院", "r2"]
    assert [(t.term, t.pos, text[t.start : t.end].lower()) for t in row[2]][:2] == [("cats", 1, "cats"), ("药", 2, "药")]
    assert row[0] == tx.terms_of(text)


def test_term_counts(spark):
    rows = [(["b", "a", "b", "ab", "b"],), ([],)]
    got = values(spark, rows, "t array<string>", tx.term_counts(F.col("t")))
    assert [(t.term, t.tf) for t in got[0][0]] == [("a", 1), ("ab", 1), ("b", 3)]
    assert got[1][0] == []


def test_style_removal(spark):
    source = "# Head\n\n* **bold** [lab\nel](u) ![i](p)\n\n\n> quote `c` &amp; <b>x</b>"
    row = values(spark, [(source,)], "t string", tx.remove_style(F.col("t")), tx.remove_style_fully(F.col("t")))[0]
    assert row[0] == "Head\n\nbold lab\nel \n\n\nquote c & x"
    assert row[1] == "Head\nbold  \nquote c & x"


def test_text_predicates(spark):
    got = values(
        spark, [("Ab c!", "ａb_C"), ("中文 A", "中文a"), ("x", "y")], "a string, b string",
        tx.almost_same(F.col("a"), F.col("b")), tx.is_english(F.col("a")),
    )
    assert [g[0] for g in got] == [False, True, False] and [g[1] for g in got] == [False, False, True]
    asked = values(spark, [("什么?",), ("什么",), ("a什么?",), ("?",)], "t string", tx.is_question(F.col("t")))
    assert [a[0] for a in asked] == [True, False, False, False]


@pytest.mark.parametrize(
    "start,end,wanted", [(0, 3, "This"), (0, -1, "This is a string"), (-3, -1, "ing"), (10, 100, "string"), (5, 3, ""), (-5, -8, "")]
)
def test_byte_range(spark, start, end, wanted):
    got = values(spark, [("This is a string",)], "s string", strings.byte_range(F.col("s"), start, end).cast("string"))
    assert got[0][0] == wanted


def test_overwrite(spark):
    got = values(
        spark, [("foo",), ("",)], "s string", strings.overwrite(F.col("s"), 5, F.lit("x")), strings.overwrite(F.col("s"), 1, F.lit("")),
        strings.overwrite(F.col("s"), 0, F.lit("ab")),
    )
    assert [tuple(bytes(c) for c in g) for g in got] == [(b"foo\0\0x", b"foo", b"abo"), (b"\0\0\0\0\0x", b"", b"ab")]


def test_bit_fields_against_integers(spark):
    rng = random.Random(5)
    data = bytes(rng.randrange(256) for _ in range(24))
    number = int.from_bytes(data, "big")
    for _ in range(12):
        width, signed = rng.randrange(1, 64), rng.random() < 0.5
        offset = rng.randrange(0, 190)
        raw = (number << 512 >> (512 + 192 - offset - width) if offset + width <= 192 else number << (offset + width - 192)) & (2**width - 1)
        wanted = raw - 2**width if signed and raw >= 2 ** (width - 1) else raw
        new = rng.randrange(2**width)
        row = values(
            spark, [(bytearray(data), new)], "b binary, n long", strings.field_get(F.col("b"), width, offset, signed),
            strings.field_get(strings.field_set(F.col("b"), width, offset, F.col("n")), width, offset), strings.field_set(F.col("b"), width, offset, F.col("n")),
        )[0]
        assert row[0] == wanted and row[1] == new
        grown = max(192, (offset + width + 7) // 8 * 8)
        mask = (2**width - 1) << (grown - offset - width)
        assert int.from_bytes(row[2], "big") & ~mask == (number << (grown - 192)) & ~mask


def test_field_overflow(spark):
    f = F.lit(120).cast("long")
    got = values(
        spark, [(1,)], "x int", strings.field_add(f, 8, 10), strings.field_add(f, 8, 10, "sat"), strings.field_add(f, 8, 10, "fail"),
        strings.field_add(F.lit(-120).cast("long"), 8, -10), strings.field_add(F.lit(2**63 - 1), 64, 1),
    )
    assert got[0] == (-126, 127, None, 126, -(2**63))


GLOBS = ["h?llo", "h*o", "h[ae]llo", "h[^e]llo", "h[a-c]llo", "h[c-a]llo", "h\\?llo", "*", "", "a.b", "[]x", "h[^]llo", "x[a\\]]y", "*[0-9]*", "[ab", "a-b"]
NAMES = ["hello", "hallo", "hbllo", "h?llo", "", "a.b", "axb", "x]y", "xay", "n7m", "a", "b", "hxllo", "a-b", "[]x"]


def test_glob_column_agrees_with_glob_text(spark):
    rows = [(n, g) for n in NAMES for g in GLOBS]
    regex = strings.glob_column_regex(F.col("g"))
    frame = spark.createDataFrame(rows, "n string, g string").withColumn("r", regex)
    got = {(r.n, r.g): r.hit for r in frame.select("n", "g", F.expr("n rlike r").alias("hit")).collect()}
    for glob in GLOBS:
        texts = spark.createDataFrame([(n,) for n in NAMES], "n string")
        hits = {r.n for r in texts.filter(strings.glob_match(F.col("n"), glob)).collect()}
        assert hits == {n for n in NAMES if got[n, glob]}, glob
        if re.fullmatch(r"[\w?*.-]*", glob):
            assert hits == {n for n in NAMES if fnmatchcase(n, glob)}


def test_time_to_live(spark):
    rows = [(True, 1500), (True, 1499), (True, None), (None, None), (True, -1), (True, 0)]
    at = F.timestamp_millis(F.col("ms") + 1_700_000_000_000)
    now = F.timestamp_millis(F.lit(1_700_000_000_000))
    got = values(spark, rows, "there boolean, ms long", strings.ttl(F.col("there"), at, now), strings.ttl(F.col("there"), at, now, "ms"))
    assert got == [(2, 1500), (1, 1499), (-1, -1), (-2, -2), (-2, -2), (0, 0)]


def test_geo_literals(spark):
    palermo, catania = (13.361389, 38.115556), (15.087269, 37.502669)
    row = values(
        spark, [(*palermo, *catania, -5.6, 42.6)], "a double, b double, c double, d double, e double, f double",
        geo.distance_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")), geo.geohash(geo.geo_cell(F.col("e"), F.col("f"))),
        geo.geo_cell(F.lit(181.0), F.lit(0.0)), geo.cell_lon(geo.geo_cell(F.col("a"), F.col("b"))), geo.cell_lat(geo.geo_cell(F.col("a"), F.col("b"))),
    )[0]
    assert 166274 < row[0] < 166275
    assert row[1] == "ezs42e44yx0"
    assert row[2] is None
    assert abs(row[3] - palermo[0]) < 1e-5 and abs(row[4] - palermo[1]) < 1e-5


JUNK = ["-", "- ", "[a ", "![a ", "[a](", "# ", "#", "`", "**a", "_", "<a ", "\t", " ", "&", "~~~"]


@pytest.mark.parametrize("unit", JUNK)
def test_style_rules_are_linear(spark, unit):
    long = F.concat(F.repeat(F.lit(unit), 1_000_000 // len(unit)), F.lit("x"))
    row = spark.range(1).select(F.length(tx.remove_style(long)).alias("a"), F.length(tx.remove_style_fully(long)).alias("b"))
    start = time.time()
    assert row.first() is not None
    assert time.time() - start < 20


@pytest.mark.parametrize("unit", ["<!-- a ", "<script>a ", "<script ", '<a href="x>', "<a ", "<h1 ", "<head>", "<title>", "<pre>", " ", "<", "&"])
def test_page_rules_are_linear(spark, unit):
    long = F.concat(F.repeat(F.lit(unit), 1_000_000 // len(unit)), F.lit("x"))
    start = time.time()
    found = spark.range(1).select(html.item(long).alias("i"), html.html_hrefs(long).alias("h")).first()
    assert found is not None and time.time() - start < 20


def test_page_parts_of_odd_markup(spark):
    page = """<head><title>t</title></head><body><a title="see href=x" href="y">k</a><pre>a
  b</pre><p>c<script>var a=1; if (a<b) {}"""
    row = spark.range(1).select(html.html_to_text(F.lit(page)).alias("t"), html.html_hrefs(F.lit(page)).alias("h")).first()
    assert row["h"] == ["y"] and row["t"] == "k\n\na\n  b\n\nc"
