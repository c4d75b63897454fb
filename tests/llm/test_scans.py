"""Language, licences, fingerprints, personal data, code search and archives on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import statistics
import textwrap
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import cws, hamming, langid, licenses, pagetext, pii, warc

FOLDER = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    truth = dict(docs.select("doc_id", "lang").collect())
    rows = [r for r in langid.identify(docs).collect() if r.held_out]
    assert len(rows) > 200
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows) > 0.97


def test_language_mixtures_and_odd_texts(spark):
    draw = random.Random(1)
    say = lambda letters, n: " ".join("".join(draw.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(i, say("abcde" if i % 2 else "vwxyz", 60), "aa" if i % 2 else "zz", 1.0) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    names, logp = langid.train(docs)
    assert names == ["aa", "zz"]
    odd = [(1, say("abcde", 300) + " " + say("vwxyz", 100)), (2, ""), (3, None), (4, "12 3!"), (5, "abcde"), (6, say("abcde", 60_000)), (6, say("vwxyz", 2)), (None, "a")]
    got = langid.predict(spark.createDataFrame(odd, "doc_id long, text string"), names, logp).collect()
    by = {(r.doc_id, i): r for i, r in enumerate(got)}
    mixed = by[(1, 0)]
    assert mixed.lang_pred == "aa" and abs(mixed.score - 0.75) < 0.05 and len(mixed.shares) == 2
    assert [by[(i, i - 1)].lang_pred for i in (2, 3, 4, 5, 6)] == ["und", "und", "und", "aa", "aa"]
    assert by[(6, 5)].score > 0.99 and len(by[(6, 5)].shares) == 1 and by[(6, 6)].lang_pred == "zz"
    assert langid.identify(docs.limit(0)).count() == 0
    unknown = langid.identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {(r.lang_pred, r.score) for r in unknown} == {("und", 0.0)}


def plain_mixture(bucket, logp):
    """One text, one trigram kind at a time: EM from equal shares, faint languages away, then the least if it pays."""
    kinds = sorted(Counter(bucket.tolist()).items())
    p = np.exp(np.array([logp[:, k] for k, _ in kinds]) - np.array([logp[:, k].max() for k, _ in kinds])[:, None])
    count = np.array([n for _, n in kinds], float)

    def climb(share, rounds):
        for _ in range(rounds):
            own = p * share
            new = (own / own.sum(axis=1)[:, None] * count[:, None]).sum(axis=0) / count.sum()
            moved, share = np.abs(new - share).max(), new
            if moved < langid.STILL:
                break
        return share, float((count * np.log((p * share).sum(axis=1))).sum())

    share, _ = climb(np.full(len(logp), 1 / len(logp)), langid.ROUNDS)
    share = np.where((share * count.sum() < 1) & (share < share.max()), 0, share)
    share /= share.sum()
    while (share > 0).sum() > 1:
        now, now_likely = climb(share, 2)
        trial = now.copy()
        trial[np.where(now > 0, now, np.inf).argmin()] = 0
        trial, likely = climb(trial / trial.sum(), langid.ROUNDS)
        if likely + langid.PENALTY * 0.5 * np.log(count.sum() + 1) <= now_likely:
            return now
        share = trial
    return share


def test_mixtures_against_a_plain_em_and_alone(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, logp = langid.train(docs)
    texts = [r.text or "" for r in docs.select("text").collect()][:250]
    texts += [" ".join(w for pair in zip(a.split(), b.split()) for w in pair) for a, b in zip(texts[:100], texts[100:200])]

    def shares_of(group):
        return np.vstack([langid.mixture(b, o - first, stop - first, logp) for first, stop, b, o in langid._trigrams(pa.array(group))])

    together = shares_of(texts)
    assert np.array_equal(together, np.vstack([shares_of([t]) for t in texts]))
    assert np.array_equal(together[::-1], shares_of(texts[::-1]))
    assert (np.sort(together, axis=1)[:, -2] > 0.2).sum() > 20
    for text, got in zip(texts, together):
        found = [b for _, _, b, _ in langid._trigrams(pa.array([text]))][0]
        if len(found):
            assert np.abs(plain_mixture(found, logp) - got).max() < 1e-6
    # rounds enough: twenty times as many and a hundredth of the step change little
    long = [np.abs(a - b).max() for a, b in zip(together, converged(shares_of, texts))]
    assert statistics.quantiles(long, n=50)[-1] < 0.02


def converged(shares_of, texts):
    still, langid.STILL = langid.STILL, langid.STILL / 100
    try:
        return shares_of(texts)
    finally:
        langid.STILL = still


def test_scores_do_not_depend_on_the_partitioning(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    key = lambda r: (r.doc_id, r.lang_pred, r.score, [tuple(s) for s in r.shares])
    one = sorted(map(key, langid.identify(docs.coalesce(1)).collect()))
    assert one == sorted(map(key, langid.identify(docs.orderBy("text").repartition(7)).collect()))


def test_unlearned_languages_go(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    draw = random.Random(4)
    noise = " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(3, 9))) for _ in range(300))
    odd = ["Это русский текст о погоде, о городе и о людях, которые живут в нём уже много лет.", "これは日本語の文章です。天気と町と人々について書いています。", noise]
    added = spark.createDataFrame([(900_000 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    every = docs.select("doc_id", "text", "lang").unionByName(added)
    kept = {r.doc_id for r in langid.keep_identified(every).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}


def test_license_lines(spark):
    lines = {
        "Licensed under the Apache License, Version 2.0.": ["apache"],
        "Released under the MIT License.": ["mit"],
        "This work is licensed under the GNU General Public License, version 3.": ["gpl"],
        "Licensed under CC BY-NC 4.0.": ["cc-by-nc"],
        "He showed his driving license and left the house.": [],
        "": [],
    }
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = licenses.Classifier(licenses.sample_paragraphs(docs, 300))
    rows = [(i, f"some text here\n{line}\n\nmore text of the page\n", "x") for i, line in enumerate(lines)] + [(None, None, "x"), (99, "word " * 50_000, "x")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, hits string"), model).collect()}
    for i, (line, families) in enumerate(lines.items()):
        assert got[i].licences == families and got[i].n_paragraphs == 5
        assert [h.line for h in got[i].hits if h.confirmed] == [1] * len(families)
    assert got[None].n_paragraphs == 1 and got[None].hits == [] and got[99].licences == []


def test_wrapped_and_dual_notices(spark):
    wrap = lambda text, width, mark: "\n".join(mark + line for line in textwrap.wrap(text, width))
    bsd = licenses.NOTICES["bsd"][0]
    option = " either version 3 of the License, or (at your option) any later version."
    agpl = licenses.NOTICES["agpl"][0][:-1] + "," + option
    lgpl = licenses.NOTICES["lgpl"][0][:-1] + " as published by the Free Software Foundation;" + option
    tail = "You should have received a copy of the GNU {} General Public License along with this program."
    plain = "the river runs along the old town and the people walk by it every day in all of the seasons " * 40
    cases = [
        (wrap(bsd, 70, " * "), ["bsd"]),
        (wrap(bsd, 72, ""), ["bsd"]),
        (wrap(agpl, 72, "# ") + "\n#\n" + wrap(tail.format("Affero"), 60, "# "), ["agpl"]),
        (wrap(lgpl, 74, "// ") + "\n//\n" + wrap(tail.format("Lesser"), 60, "// "), ["lgpl"]),
        (wrap(licenses.NOTICES["gpl"][1], 72, " * "), ["gpl"]),
        (wrap(licenses.NOTICES["cc-by-sa"][0], 50, ""), ["cc-by-sa"]),
        (wrap(licenses.NOTICES["mit"][1], 70, ""), ["mit"]),
        ("Released under the MIT License. Licensed under the Apache License, Version 2.0.", ["apache", "mit"]),
        ("Licensed under the MIT License or the Apache License, Version 2.0.", ["apache", "mit"]),
        (plain + bsd + " " + plain, ["bsd"]),
        (plain + "Released under the MIT License. " + plain, ["mit"]),
        (plain, []),
        (bsd[:60] + "\n\n" + bsd[60:], []),
    ]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = licenses.Classifier(licenses.sample_paragraphs(docs, 300))
    rows = [(i, f"first line\n\n{text}\n\nlast line") for i, (text, _) in enumerate(cases)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i].licences for i in range(len(cases))] == [families for _, families in cases]
    assert [h.line for h in got[0].hits if h.confirmed] == [2]


def jaccard(a, b):
    a, b = Counter(re.findall(r"[^\x20\x09-\x0D]+", a)), Counter(re.findall(r"[^\x20\x09-\x0D]+", b))
    whole = sum((a | b).values())
    return sum((a & b).values()) / whole if whole else 1.0


def test_fingerprints(spark):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randrange(1, 120))) for _ in range(120)]
    texts += ["", "  ", texts[0], texts[0], "é" * 5000, "a b " * 20_000]
    rows = [(i * 7, t, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in cws.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")).collect()}
    order = sorted(rows, reverse=True)
    errors = []
    for k, (i, t, _) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        errors += [got[i].near_edited - jaccard(t, edited), got[i].near_next - jaccard(t, after)]
    assert abs(statistics.mean(errors)) < 0.02 and statistics.pstdev(errors) < 0.1
    same = [got[i].fingerprint for i, t, _ in rows if t == texts[0]]
    assert len(same) == 3 and len(set(same)) == 1
    assert got[840].fingerprint == got[847].fingerprint


def test_fingerprints_of_odd_tables(spark):
    one = cws.fingerprints(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"a b a").hexdigest()
    odd = spark.createDataFrame([(None, "x y"), (3, None), (3, None), (5, "x y")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_chars) for r in cws.fingerprints(odd).collect()) == [(-1, 3), (3, 0), (3, 0), (5, 3)]
    assert cws.fingerprints(odd.limit(0)).count() == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and pii.luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def test_base_spans_follow_the_patterns():
    draw = random.Random(6)
    parts = ["a", "é", "@", ".", "b.c", "x@y.z", "_", "%", "+1", " ", "-", "(555)", "4532015112830366", "1.2.3.4", "256", "0", "12", "\n", "00000255.1.1.1"]
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(25)))
        want = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE) for m in re.finditer(p, text) if passes(kind, m.group()))
        assert pii.base_spans(text)[0] == want, text


@pytest.mark.parametrize("unit", ["1", "a", "@", "1.", "+", "a@", "1-", "+1 ", "a.", "(at)", " dot ", "a@b.", "1 "])
def test_base_scan_is_linear(unit):
    text = unit * (400_000 // len(unit))
    pii.base_spans(text)
    list(pii._loose_spans(text))


def test_personal_data(spark):
    mail = "write to john.smith (at) example (dot) com today"
    rows = [(i, f"contact me: user{i}@mail.example.com or phone +1 (212) 555-01{i % 90 + 10}", "x") for i in range(60)]
    rows += [(100 + i, f"order number 1234567890{i:04d} was sent, version 1.2.3.400", "x") for i in range(40)]
    rows += [(300, mail, "x"), (301, None, "x"), (302, "", "x"), (None, "a@b.cd", "x")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    assert len(got) == len(rows)
    assert got[0].n_email == 1 and got[0].n_phone == 1 and got[301].base == "" and got[None].spans == "email:0:6"
    assert all(got[100 + i].spans == got[100 + i].base for i in range(40))
    for r in got.values():
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
        assert r.base_sha256 == hashlib.sha256(r.base.encode()).hexdigest()


@pytest.mark.parametrize("base,spelled", [(60, 1), (60, 60), (3000, 1), (3000, 400), (0, 1), (5, 2000)])
def test_spelled_addresses_are_added_whatever_the_corpus(spark, base, spelled):
    forms = ["name{} (at) example (dot) com", "write to name{}[at]example[dot]org", "email me: name{} at example dot com"]
    rows = [(i, f"contact me: user{i}@mail.example.com or phone +1 (212) 555-01{i % 90 + 10}") for i in range(base)]
    rows += [(10_000 + i, f"order number 1234567890{i:04d} was sent, version 1.2.3.400") for i in range(200)]
    rows += [(20_000 + i, f"the point at line dot therefore {i}") for i in range(50)]
    rows += [(30_000 + i, "see " + forms[i % 3].format(i) + " today") for i in range(spelled)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[30_000 + i].added == 1 for i in range(spelled))
    assert all(r.added == 0 for i, r in got.items() if i < 30_000)


def test_taken_places_against_all_pairs():
    draw = random.Random(8)
    for _ in range(300):
        spans = [(a, 0, a + draw.randint(1, 9)) for a in (draw.randrange(80) for _ in range(draw.randrange(6)))]
        room, held = pii.Taken(spans), list(spans)
        for _ in range(20):
            start = draw.randrange(90)
            end = start + draw.randint(1, 6)
            free = not any(a < end and start < b for a, _, b in held)
            assert room.free(start, end) == free
            if free and draw.random() < 0.5:
                room.add(start, end)
                held.append((start, 0, end))


def test_a_long_text_of_candidates(spark):
    unit = "see name (at) example (dot) com, ring (212) 555-0134, "
    n = 5_000_000 // len(unit)
    frame = spark.createDataFrame([(1, unit * n), (2, unit), (3, "")], "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: r.added for r in pii.personal_data(frame).collect()}
    assert got[2] >= 1 and got == {1: got[2] * n, 2: got[2], 3: 0}
    assert time.monotonic() - began < 60


def test_reliabilities_find_the_bad_labeler():
    draw = np.random.default_rng(0)
    truth = draw.random(4000) < 0.4
    right = [0.95, 0.9, 0.55, 0.9]
    ballots = np.stack([np.where(draw.random(4000) < p, truth, ~truth) for p in right], axis=1)
    ballots = np.where(ballots, 1, 2)
    likely = pii.reliabilities(np.zeros(4000, int), ballots, np.ones(4000))
    assert ((likely > 0.5) == truth).mean() > 0.95


def test_hamming_search_equals_brute_force(spark):
    draw = random.Random(8)
    centre = [[draw.choice([-1.0, 1.0]) for _ in range(70)] for _ in range(3)]
    vectors = []
    for i in range(160):
        v = [x if draw.random() > 0.1 else -x for x in centre[i % 3]]
        vectors.append((i, v if i % 5 else centre[0], "x"))
    vectors += [(500, None, "x"), (None, centre[0], "x"), (501, [1.0], "x"), (502, [], "x"), (503, [None, 1.0], "x"), (3, vectors[3][1], "x")]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, rank string")
    codes = hamming.codes(frame, "vec_id", "embedding")
    bits = {i: [(x or 0) > 0 for x in v] + [False] * (70 - len(v)) for i, v, _ in vectors if i is not None and v is not None}
    for k in (1, 7):
        got = hamming.nearest(codes, codes.filter("id % 20 = 0 or id > 400"), k).collect()
        for q in [i for i in bits if i % 20 == 0 or i > 400]:
            want = sorted((sum(a != b for a, b in zip(bits[q], bits[i])), i) for i in bits if i != q)[:k]
            assert [(r.distance, r.id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert hamming.nearest(codes.limit(0), codes.limit(0), 3).count() == 0
    assert hamming.nearest(codes.filter("id < 2"), codes.filter("id = 0"), 3).count() == 1


PAGE = """<!DOCTYPE html><head><title>A &amp; B</title><meta name=Description content="what it is"><style>p{}</style>
<script>var a=1; if (a<b) {}</script></head><body><h1>Head</h1><p>One <b>two</b>
three<br>four</p><pre>x
  y</pre><a title="see href=z" href='/q?a=1&amp;b=2'>link</a><!-- gone --><script>open"""


def test_page_text():
    page = pagetext.PageText(PAGE)
    assert (page.title, page.metas, page.links) == ("A & B", {"description": "what it is"}, ["/q?a=1&b=2"])
    assert page.text == "Head\n\nOne two three\nfour\n\nx\n  y\n\nlink"
    assert pagetext.PageText("").text == "" and pagetext.PageText("a <!-- b").text == "a" and pagetext.PageText("1 < 2").text == "1 < 2"


@pytest.mark.parametrize("unit", ["<!-- a ", "<script>a ", "<a ", '<a href="x>', "<", "<a '", "<title>", "&", "<pre>", "</"])
def test_page_text_is_linear(unit):
    pagetext.PageText(unit * (1_000_000 // len(unit)))


def test_derived_records_and_files(spark, tmp_path):
    rows = [(1, "http://a.example/", PAGE, "x"), (2, None, None, "x"), (3, "http://b.example/", "plain\r\n\r\ntext", "x"), (3, "http://b.example/", "plain\r\n\r\ntext", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    responses = warc.responses_of_pages(pages)
    made = warc.derive(responses)
    got = made.collect()
    assert len(got) == 8 and len({r.record_id for r in got}) == 6
    origin = {r.record_id: r for r in responses.collect()}
    for r in got:
        source = origin[r.refers_to]
        assert (r.target_uri, r.date, r.payload_digest, r.source_block_digest, r.source_http) == (
            source.target_uri, source.date, source.payload_digest, source.block_digest, source.http)
        assert r.content_length == len(r.block.encode())
        if r.record_type == "metadata":
            assert f"conversion: {r.concurrent_to}\r\n" in r.block and source.payload_digest in r.block and "source-header: Content-Type: text/html" in r.block
    import base64

    text = next(r for r in got if r.record_type == "conversion" and r.page_id == 1)
    assert text.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(text.block.encode()).digest()).decode()
    warc.write_warc(made, str(tmp_path / "derived"))
    read = warc.read_warc(spark, str(tmp_path / "derived")).collect()
    assert len(read) == 8 and all(r.whole for r in read)
    assert {(r.headers["warc-record-id"], r.headers["warc-refers-to"], bytes(r.block).decode()) for r in read} == {(r.record_id, r.refers_to, r.block) for r in got}
    warc.write_warc(warc.response_records(responses), str(tmp_path / "responses"))
    back = warc.responses_of_records(warc.read_warc(spark, str(tmp_path / "responses")))
    assert sorted((r.record_id, r.payload, r.block_digest) for r in back.collect()) == sorted((r.record_id, r.payload, r.block_digest) for r in responses.collect())
    assert warc.derive(responses.limit(0)).count() == 0


def test_archives_of_other_writers(spark, tmp_path):
    def record(version, block, *heads, length=None):
        lines = [f"WARC/{version}", *heads, f"Content-Length: {len(block.encode()) if length is None else length}"]
        return "\r\n".join(lines) + "\r\n\r\n" + block + "\r\n\r\n"

    page = "HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<title>T{}</title><p>é text</p>"
    heads = lambda i, *more: ("WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{i}>", f"WARC-Target-URI: http://a.example/{i}", "WARC-Date: 2020-02-02T00:00:00Z", *more)
    declared = ("WARC-Payload-Digest: sha256:abc", "WARC-Block-Digest: md5:def", "WARC-IP-Address: 192.0.2.7")
    twice = ("WARC-Concurrent-To: <urn:uuid:x>", "WARC-Concurrent-To: <urn:uuid:y>")
    text = record("1.0", "software: z\r\n", "WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:0>")
    text += record("1.0", page.format(1), *heads(1, *declared)) + record("1.0", page.format(2), *heads(2, *twice))
    text += record("1.1", "", "WARC-Type: metadata", "WARC-Record-ID: <urn:uuid:m>") + record("1.1", page.format(3) + "\r\n\r\n", *heads(3))
    text += record("1.0", page.format(4) + "\r\n\r\nWARC/1.0\r\nnot a record", *heads(4)) + record("1.0", page.format(5), *heads(5))
    (tmp_path / "in.warc").write_bytes(text.encode())
    records = warc.read_warc(spark, str(tmp_path / "in.warc"))
    seen = {r.headers["warc-record-id"]: r for r in records.collect() if "warc-record-id" in r.headers}
    assert set(seen) == {f"<urn:uuid:{i}>" for i in "012m345"}
    assert all(r.whole for r in seen.values()) and bytes(seen["<urn:uuid:m>"].block) == b""
    assert bytes(seen["<urn:uuid:4>"].block).endswith(b"\r\n\r\nWARC/1.0\r\nnot a record")
    assert [f.value for f in seen["<urn:uuid:2>"].fields if f.name == "WARC-Concurrent-To"] == ["<urn:uuid:x>", "<urn:uuid:y>"]
    responses = warc.responses_of_records(records)
    by = {r.record_id[-2]: r for r in responses.collect()}
    assert sorted(by) == list("12345")
    assert (by["1"].payload_digest, by["1"].block_digest) == ("sha256:abc", "md5:def")
    assert by["3"].payload.endswith("\r\n\r\n") and by["2"].payload_digest.startswith("sha1:")
    made = {r.refers_to[-2]: r for r in warc.derive(responses).collect() if r.record_type == "metadata"}
    assert "source-payload-digest: sha256:abc\r\n" in made["1"].block and "source-warc-header: WARC-IP-Address: 192.0.2.7\r\n" in made["1"].block
    assert "source-truncated" not in made["4"].block
    assert made["2"].block.count("source-warc-header: WARC-Concurrent-To: ") == 2


def test_gzip_members_charsets_and_wrong_lengths(spark, tmp_path):
    """Bytes go through unchanged: digests fit, payloads are decoded by their own charset, cut records are kept."""
    import base64
    import gzip

    def record(i, block, length=None, kind="response"):
        heads = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{i}>", "WARC-Target-URI: http://a.example/", f"Content-Length: {len(block) if length is None else length}"]
        return "\r\n".join(["WARC/1.0", *heads]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    def http(body, *heads):
        return "\r\n".join(["HTTP/1.1 200 OK", *heads]).encode("latin-1") + b"\r\n\r\n" + body

    text = "<title>Größe</title>\r\n\r\nWARC/1.0 naïve"
    meta = '<meta http-equiv="Content-Type" content="text/html; charset=koi8-r"><title>Привет</title>'
    chunked = b"5\r\nabcde\r\n3;x=y\r\nfgh\r\n0\r\n\r\n"
    blocks = {
        1: http(text.encode("latin-1"), "Content-Type: text/html; charset=ISO-8859-1"),
        2: http(meta.encode("koi8-r"), "Content-Type: text/html"),
        3: http(gzip.compress(text.encode()), "Content-Encoding: gzip", "Content-Type: text/html"),
        4: http(chunked, "Transfer-Encoding: chunked"),
        5: http(b"\x89PNG\x00\xff", "Content-Type: image/png"),
        6: http("日本".encode("utf-16"), "Content-Type: text/plain; charset=no-such"),
        7: http(b"", "Content-Type: text/html; charset=zlib"),
    }
    want = {1: text, 2: meta, 3: text, 4: "abcdefgh", 5: "", 6: "日本", 7: ""}
    (tmp_path / "in").mkdir()
    members = b"".join(gzip.compress(record(i, b)) for i, b in blocks.items())
    (tmp_path / "in" / "a.warc.gz").write_bytes(members)
    got = {r.record_id: r for r in warc.responses_of_records(warc.read_warc(spark, str(tmp_path / "in"))).collect()}
    assert len(got) == len(blocks)
    for i, block in blocks.items():
        row = got[f"<urn:uuid:{i}>"]
        assert row.payload == want[i] and row.whole
        assert row.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        assert row.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(block.partition(b"\r\n\r\n")[2]).digest()).decode()
    assert got["<urn:uuid:1>"].charset == "cp1252" and got["<urn:uuid:5>"].charset is None
    made = warc.derive(warc.responses_of_records(warc.read_warc(spark, str(tmp_path / "in")))).collect()
    assert any("title: Größe\r\n" in r.block for r in made) and any("title: Привет\r\n" in r.block for r in made)

    # a length too long, too short, missing, and a file that ends inside a member; the records beside them stay whole
    odd = [record(1, b"aa"), record(2, b"bbbb", length=9), record(3, b"cccc\r\ncc", length=2), record(4, b"dd", length="x"), record(5, b"ee"), record(6, b"f" * 90_000)]
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "b.warc").write_bytes(b"".join(odd))
    for name, data in (("b.warc", b"".join(odd)), ("c.warc.gz", b"".join(map(gzip.compress, odd)))):
        (tmp_path / "odd" / name).write_bytes(data[:-20] if name == "c.warc.gz" else data[:-100])
        rows = warc.read_warc(spark, str(tmp_path / "odd" / name)).collect()
        found = {r.headers["warc-record-id"][-2]: (bytes(r.block), r.whole) for r in rows}
        assert len(rows) == 6
        assert [found[i] for i in "12345"] == [(b"aa", True), (b"bbbb", False), (b"cccc\r\ncc", False), (b"dd", False), (b"ee", True)]
        assert found["6"][0] == b"f" * len(found["6"][0]) and (not found["6"][1] or name == "c.warc.gz")
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.warc").write_bytes(b"")
    assert warc.responses_of_records(warc.read_warc(spark, str(tmp_path / "none"))).count() == 0
