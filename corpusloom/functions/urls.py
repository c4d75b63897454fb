"""URL columns: parts, canonical form, fingerprint, site, resolution of links."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.binding import let

# Generic URI split of RFC 3986, appendix B. Groups: 2 scheme, 3 //authority,
# 4 authority, 5 path, 6 ?query, 7 query, 8 #fragment.
URI = r"^(([a-zA-Z][a-zA-Z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#.*)?$"

# Public suffixes of more than one label; every last label is one too.
SUFFIXES = (
    "co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk net.uk sch.uk nhs.uk police.uk "
    "com.cn net.cn org.cn gov.cn edu.cn ac.cn mil.cn com.hk org.hk gov.hk edu.hk com.tw org.tw gov.tw edu.tw "
    "co.jp or.jp ne.jp ac.jp go.jp co.kr or.kr go.kr ac.kr com.au net.au org.au edu.au gov.au id.au "
    "co.nz org.nz net.nz govt.nz ac.nz co.in net.in org.in gov.in ac.in edu.in com.br org.br gov.br edu.br "
    "com.mx org.mx gob.mx com.ar org.ar gob.ar com.tr org.tr gov.tr edu.tr com.sg org.sg gov.sg edu.sg "
    "com.my org.my gov.my edu.my co.za org.za gov.za ac.za co.il org.il ac.il gov.il com.ua gov.ua "
    "com.pl org.pl edu.pl gov.pl com.ru co.th or.th ac.th go.th co.id or.id ac.id go.id com.vn edu.vn gov.vn "
    "com.ph gov.ph edu.ph com.sa gov.sa com.eg gov.eg"
).split()

# Characters that a path keeps as they are, besides letters and digits.
_PATH_SAFE = "-._~:/?#[]@!$&'()*+,;=%"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URI, group)


def host(url: Column) -> Column:
    """Lower-cased host without user and port."""
    return F.lower(F.regexp_replace(part(url, 4), r"^.*@|:[0-9]*$", ""))


def url_origin(url: Column) -> Column:
    """``scheme://authority/``."""
    return F.concat(F.lower(part(url, 2)), F.lit("://"), part(url, 4), F.lit("/"))


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _form_encoded(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A"))


def _canonical_path(path: Column) -> Column:
    # An escaped slash or question mark stays escaped; a plus is not a space here.
    kept = F.regexp_replace(path, "%2[fF]", "%252F")
    kept = F.regexp_replace(kept, "%3[fF]", "%253F")
    coded = F.url_encode(let(F.replace(kept, F.lit("+"), F.lit("%2B")), _decoded))
    coded = F.replace(coded, F.lit("+"), F.lit("%20"))
    for char in _PATH_SAFE:
        if char not in "-._*":
            coded = F.replace(coded, F.lit(f"%{ord(char):02X}"), F.lit(char))
    plain = path.rlike(r"^[a-zA-Z0-9\-._~:/\[\]@!$&'()*+,;=]*\z")
    return F.when(path == "", F.lit("/")).when(plain, path).otherwise(coded)


def _canonical_query(query: Column) -> Column:
    pairs = F.filter(F.split(query, "[&;]"), lambda p: p != "")

    def decode(pair: Column) -> Column:
        return F.struct(
            _decoded(F.substring_index(pair, "=", 1)).alias("k"),
            F.when(pair.contains("="), _decoded(F.regexp_replace(pair, "^[^=]*=", ""))).otherwise("").alias("v"),
        )

    ordered = F.array_sort(F.transform(pairs, decode))
    coded = F.transform(ordered, lambda p: F.concat(_form_encoded(p["k"]), F.lit("="), _form_encoded(p["v"])))
    return let(F.array_join(coded, "&"), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def canonical_url(url: Column) -> Column:
    """Lower-cased host, normal percent-encoding, sorted query, no fragment."""
    return let(
        F.trim(url),
        lambda u: F.concat(
            F.lower(part(u, 1)),
            F.regexp_replace(F.lower(part(u, 3)), ":$", ""),
            let(part(u, 5), _canonical_path),
            _canonical_query(part(u, 7)),
        ),
    )


def url_fingerprint(url: Column, headers: Mapping[str, Column] | None = None) -> Column:
    """SHA-1 of the canonical URL; named headers are appended if they are present."""
    text = [canonical_url(url)]
    for name in sorted(headers or {}, key=str.lower):
        value = headers[name]
        text.append(F.when(value.isNotNull(), F.concat(F.lit(name.lower()), value)).otherwise(""))
    return F.sha1(F.concat(*text))


def registered_domain(url: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """Public suffix and the label before it; a bare name or an address stays whole."""
    by_size: dict[int, list[str]] = defaultdict(list)
    for suffix in suffixes:
        by_size[suffix.count(".") + 1].append(suffix)

    def site(name: Column) -> Column:
        address = name.rlike(r"^[0-9.]+$|^\[|:") | ~name.contains(".")
        found = F.when(address, name)
        for size in sorted((s for s in by_size if s > 1), reverse=True):
            tail = F.substring_index(name, ".", -size)
            found = found.when(tail.isin(by_size[size]), F.substring_index(name, ".", -size - 1))
        return found.otherwise(F.substring_index(name, ".", -2))

    return let(host(url), site)


def allowed_host(url: Column, domains: str) -> Column:
    """True if the host is one of the comma-separated domains or below one; an empty list allows all."""
    wanted = [d.strip().lower() for d in domains.split(",") if d.strip()]
    if not wanted:
        return F.lit(True)

    def allowed(name: Column) -> Column:
        test = name.isin(wanted)
        for domain in wanted:
            test = test | name.endswith("." + domain)
        return test

    return let(host(url), allowed)


def document_id(url: Column, code: Column, title: Column, keywords: Column) -> Column:
    """Fingerprint of the url, else the code, else the MD5 of title and keywords."""
    digest = F.md5(F.concat(F.coalesce(title, F.lit("")), F.coalesce(keywords, F.lit(""))))
    return F.coalesce(F.when(url.isNotNull(), url_fingerprint(url)), code, digest)


def document_url(url: Column, code: Column, default: str) -> Column:
    """The url; a document with neither url nor code gets the default."""
    return F.when(url.isNull() & code.isNull(), F.lit(default)).otherwise(url)


def _without_dots(path: Column) -> Column:
    def fold(steps: Column) -> Column:
        def walk(done: Column, step: Column) -> Column:
            up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
            return F.when(step == "..", up).when(step == ".", done).otherwise(F.concat(done, F.array(step)))

        kept = F.aggregate(F.slice(steps, 2, F.size(steps)), F.array(F.lit("")), walk)
        end = F.when(F.element_at(steps, -1).isin(".", ".."), F.lit("/")).otherwise("")
        return F.concat(F.array_join(kept, "/"), end)

    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), let(F.split(path, "/"), fold)).otherwise(path)


def parts(url: Column) -> Column:
    """``struct<scheme, authority, path, query, fragment>`` with their marks (``:``, ``//``, ``?``, ``#``)."""
    names = {"scheme": 1, "authority": 3, "path": 5, "query": 6, "fragment": 8}
    return F.struct(*[part(url, group).alias(name) for name, group in names.items()])


def resolve_parts(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` on a page given by its ``parts``."""

    def join(h: Column) -> Column:
        start = F.concat(base["scheme"], base["authority"])
        tail = F.concat(h["query"], h["fragment"])
        folder = F.when(base["path"] == "", F.lit("/")).otherwise(F.regexp_replace(base["path"], "[^/]*$", ""))
        merged = F.when(h["path"].startswith("/"), h["path"]).otherwise(F.concat(folder, h["path"]))
        same_page = F.concat(
            start, base["path"], F.when(h["query"] != "", h["query"]).otherwise(base["query"]), h["fragment"]
        )
        return (
            F.when(h["scheme"] != "", href)
            .when(h["authority"] != "", F.concat(base["scheme"], h["authority"], let(h["path"], _without_dots), tail))
            .when(h["path"] == "", same_page)
            .otherwise(F.concat(start, let(merged, _without_dots), tail))
        )

    return let(parts(href), join)


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link found on the page ``base``."""
    return let(parts(base), lambda b: resolve_parts(b, href))
