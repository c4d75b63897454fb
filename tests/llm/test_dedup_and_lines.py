"""Near copies, components and repeated lines against brute force."""

from __future__ import annotations

import random
import re
import time

import pyarrow as pa
import pytest

import corpus_pipeline
from corpusloom.llm import components, lines, minhash, wordhash

SCHEMA = "doc_id long, text string, lang string, component_id string, n_dropped int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "x", 1) for i, t in rows], SCHEMA)


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def classes(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_shingle_sets_follow_the_words():
    texts = ["a b c d e f", "A  b\tc\nd E f", "a b", "", None, "x " * 300_000, "é Ü ß 1 2 3", "word" * 100_000, "a b c d e f a b c d e f"]
    sizes = [len(s) for s in wordhash.shingle_sets(pa.array(texts))]
    assert sizes == [len(shingles(t)) for t in texts]
    first, second, *_ = wordhash.shingle_sets(pa.array(texts))
    assert first.tolist() == second.tolist()


def test_long_words_count_once():
    texts = ["中" * 100_000, "a b " + "xy" * 150_000 + " c d e", "a b " + "XY" * 150_000 + " c d e", "w " * 140_000 + "é" * 300_000 + " z" * 9, "q" * 262_144, "q" * 262_145 + " "]
    sets = list(wordhash.shingle_sets(pa.array(texts)))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert sets[1].tolist() == sets[2].tolist()


def test_components_of_random_graphs(spark):
    draw = random.Random(7)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    edges += [(2000, 2001 + i) for i in range(50)]
    df = spark.createDataFrame([*edges, (None, 3)], "u long, v long")
    found = {r.node: r.component for r in components.components(df).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert found == classes([e for e in edges if e[0] != e[1]], linked)
    assert components.components(df.filter("u < 0")).count() == 0


@pytest.mark.parametrize("block", [4, 256])
def test_near_duplicates(spark, block):
    draw = random.Random(block)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(6):
        base = [draw.choice(words) for _ in range(draw.choice([30, 120]))]
        for _ in range(12):
            text = list(base)
            for _ in range(draw.randrange(5)):
                text[draw.randrange(len(text))] = draw.choice(words)
            rows.append(" ".join(text))
    rows += [rows[0]] * 9 + [rows[0].upper(), "", None, "one two", "One  two", "one", " \n", "z " * 4000]
    draw.shuffle(rows)
    docs = [(i, t) for i, t in enumerate(rows)]
    sets = {i: shingles(t) for i, t in docs}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    want = classes(links, sets)
    frame = table(spark, [*docs, docs[0], (None, "a b c d e f")])
    got = minhash.near_duplicates(frame, block=block).collect()
    assert len(got) == len(docs) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


def line_rule(docs):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(i, first.get(key(line), i))
    out = {}
    for i, t in docs:
        parts = (t or "").split("\n")
        kept = [p for p in parts if len(key(p)) < 10 or first[key(p)] == i]
        out[i] = (len(parts), len(parts) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(spark):
    draw = random.Random(2)
    pool = ["a common line of text", "  A Common LINE of text\t", "short", "", "ÉCOLE école école", "the quick brown fox", " " * 12, "0123456789"]
    docs = [(i * 3, "\n".join(draw.choice([*pool, f"own line number {i}"]) for _ in range(draw.randrange(1, 150)))) for i in range(60)]
    docs += [(500, ""), (501, None), (502, "\n\n"), (503, "a common line of text"), (504, "x" * 200_000 + "\n" + "a common line of text")]
    want = line_rule(docs)
    frame = table(spark, docs)
    got = lines.dedup_lines(frame).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in got} == want
    marks = {r.doc_id: r for r in lines.keep_bitmaps(frame).collect()}
    assert {i: m.n_dropped for i, m in marks.items()} == {i: w[1] for i, w in want.items() if w[1]}
    for i, m in marks.items():
        kept = [(w.word * lines.BITS + b) for w in m["words"] for b in range(lines.BITS) if not w.bits >> b & 1]
        assert len(kept) == m.n_dropped
    assert lines.dedup_lines(frame.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 59, 60, 61, 119, 120, 121, 600])
def test_bitmaps_of_all_sizes(spark, n):
    draw = random.Random(n)
    docs = [(i, "\n".join(draw.choice(["", "short", f"a line of its own {i} {k}", f"a shared line {k % 40}"]) for k in range(n))) for i in range(12)]
    docs += [(20 + i, "\n".join("the same line in all" for _ in range(n))) for i in range(3)]
    got = lines.dedup_lines(table(spark, docs)).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got} == line_rule(docs)


def test_line_dedup_of_a_million_lines(spark):
    text = "\n".join(f"2026-01-01 entry {k} of a log file" for k in range(1_000_000))
    frame = table(spark, [(1, text), (2, text + "\nthe end of it")])
    began = time.monotonic()
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.n) for r in lines.dedup_lines(frame).selectExpr("*", "length(text) as n").collect()}
    assert got == {1: (1_000_000, 0, len(text)), 2: (1_000_001, 1_000_000, 13)}
    assert time.monotonic() - began < 60


def test_line_dedup_with_odd_ids(spark):
    frame = table(spark, [(None, "some repeated line"), (4, "some repeated line"), (4, "some repeated line"), (None, "some repeated line\nx")])
    got = sorted((r.doc_id or -1, r.text) for r in lines.dedup_lines(frame).collect())
    assert got == [(-1, ""), (-1, "x"), (4, "some repeated line"), (4, "some repeated line")]


def test_stage_links_from_080(spark):
    docs = []
    for group in range(40):
        base = [f"g{group}w{i}" for i in range(200)]
        docs.append((10 * group, " ".join(base)))
        for k in range(1, 4):  # each changed word in the middle breaks five shingles
            text = list(base)
            for j in range(3 + (group + k) % 4):
                text[10 + 30 * j - 7 * k if j else 10 + 3 * k] = f"other{group}{k}{j}"
            docs.append((10 * group + k, " ".join(text)))
    sets = {i: shingles(t) for i, t in docs}
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and a // 10 == b // 10}
    assert sum(0.80 <= v < 0.85 for v in like.values()) > 20 and any(0.7 < v < 0.80 for v in like.values())
    want = classes([pair for pair, v in like.items() if v >= 0.80], sets)
    frame = table(spark, docs)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()} == {i for i in sets if want[i] == i}
