"""Token packing against the tokenizer itself, the mix against its own arithmetic, and the pipeline's stages."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import mixing, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_the_tokenizers():
    draw = random.Random(3)
    parts = list("abAB19 \t\n'’,.-éÉß́ 中Σσ!<|>=") + ["'s", "<|endoftext|>", "<|ENDOFTEXT|>", "don't", "İ", "ﬁ", "\x1c", "̸"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(3000)] + ["", None, "x" * 3000, "a b " * 90_000]
    plain = Tokenizer.from_file(PATH)
    for text, ids in zip(texts, packing.WordTokenizer(PATH).encode(pa.array(texts))):
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_words_longer_than_a_block_are_not_cut():
    draw = random.Random(5)
    texts = ["中文字" * 34_000 + "。日本", "a " + "".join(draw.choice("abcdefghijkl") for _ in range(300_000)) + " b c", "x1" * 200_000, "é" * 140_000 + " end"]
    plain = Tokenizer.from_file(PATH)
    for text, ids in zip(texts, packing.WordTokenizer(PATH).encode(pa.array(texts))):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_small_cache_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_PARTS", 5)
    texts = ["one two three", "four five six seven eight nine ten", "one", None, "a b c d e f g h i j k"]
    plain = Tokenizer.from_file(PATH)
    for text, ids in zip(texts, packing.WordTokenizer(PATH).encode(pa.array(texts))):
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_best_fit_places_every_piece_once(spark):
    draw = random.Random(1)
    sizes = [draw.choice([1, 7, 100, 33, draw.randrange(1, 101), 50]) for _ in range(900)]
    frame = spark.createDataFrame(list(enumerate(sizes)), "id long, length long")
    rows = packing.best_fit(frame, 100).collect()
    assert sorted(r.id for r in rows) == list(range(900))
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, sizes[r.id]))
    for own in held.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= 100
    assert len(held) <= math.ceil(sum(sizes) / 100) * 1.03 + 1
    assert packing.best_fit(frame.limit(0), 100).count() == 0


def test_pack_documents_gives_back_the_tokens(spark):
    texts = {1: "hello world", 2: "", 3: None, 4: "many words " * 3000, 5: "hello world"}
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()] + [(5, "hello world", 0), (None, "x", 0)], "doc_id long, text string, length int")
    plain = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(docs, PATH, capacity=512).collect()
    for i, t in texts.items():
        own = sorted((r.piece, r) for r in rows if r.doc_id == i)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for _, r in own]).tolist()
        whole = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        assert ids == whole * (2 if i == 5 else 1)
        if i != 5:
            assert [r.start for _, r in own] == list(range(0, len(whole), 512))
    assert zlib.crc32(b"") == 0 and len({r.sequence_id for r in rows}) <= math.ceil(sum(r.length for r in rows) / 512) + 1


def test_sequences_follow_the_written_order(spark, tmp_path):
    rows = [(i * 7 % 1000, f"word{i} " * (40 + i * 13 % 50), i) for i in range(1000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, at long")
    frame.repartitionByRange(5, "at").sortWithinPartitions("at").write.parquet(str(tmp_path / "mix"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        placed = packing.in_file_order(spark.read.parquet(str(tmp_path / "mix"))).collect()
        order = [r.at for r in sorted(placed, key=lambda r: r["_position"])]
        assert order == list(range(1000)) and len({r["_position"] for r in placed}) == 1000
        docs = packing.in_file_order(spark.read.parquet(str(tmp_path / "mix")))
        got = packing.pack_in_order(packing.pieces(docs, PATH, capacity=2048, order="_position"), 2048).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, _ in rows)
    assert [r.sequence_time for r in got] == sorted(r.sequence_time for r in got)
    seen, held = [], defaultdict(list)
    for r in got:
        seen.append(r.sequence_id)
        held[r.sequence_id].append(r)
    assert sum(a != b for a, b in zip(seen, seen[1:])) == len(held) - 1
    for own in held.values():
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        mean = sum(r.position * r.length for r in own) / sum(r.length for r in own)
        assert abs(mean - own[0].sequence_time) <= 1e-9 * mean
    want = {(r.doc_id, r.piece): bytes(r.ids) for r in packing.pieces(docs, PATH, capacity=2048).collect()}
    assert {(r.doc_id, r.piece): bytes(r.ids) for r in got} == want
    ids = {1: [1, 65_535], 2: [65_536, 3], 3: [2**32 - 1], 4: [0]}
    raw = [(d, d, 0, 0, len(v), bytearray(b"".join(i.to_bytes(4, "little") for i in v))) for d, v in ids.items()]
    cut = spark.createDataFrame(raw, "doc_id long, position long, piece int, start long, length long, ids binary")
    assert {r.doc_id: bytearray(r.ids) for r in packing.pack_in_order(cut).collect()} == {r[0]: r[5] for r in raw}
    unordered = packing.in_file_order(spark.range(10).union(spark.range(10)))
    assert [r["_position"] for r in unordered.collect()] == sorted(r["_position"] for r in unordered.collect())
    assert packing.pack_in_order(packing.pieces(docs.limit(0), PATH, order="_position")).count() == 0


def targets_by_rounds(sizes, most):
    """Reshare the excess until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return {**fixed, **share}
        fixed.update({s: most * sizes[s] for s in over})


def mix_table(spark, seed=4):
    draw = random.Random(seed)
    rows = []
    for i in range(400):
        source = draw.choice(["big"] * 6 + ["tiny", "mid", None, "Zed", "éa"]) if i > 3 else "tiny"
        rows.append((i, source, " ".join(["w"] * draw.randrange(60)), 9))
    rows += [(900, "mid", None, 1), (901, "mid", "", 1), (902, "empty", " \t\n", 1), (7, "big", "again a row", 1), (7, "big", "again a row", 1), (None, "mid", "no id here", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string, taken int")


def test_curriculum(spark):
    rows, frame = mix_table(spark)
    got = mixing.curriculum(frame).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, s, t, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets_by_rounds(sizes, 3)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"] and len(r.times) == -(-r.taken // r["size"] if r["size"] else 0)
        assert all(0 <= t <= 1 for t in r.times) and list(r.times) == sorted(r.times)
        taken[r.source] += r.taken
    for s, t in taken.items():
        assert want[s] - 1 <= t <= want[s]
    order = [r.times[0] if r.times else 2.0 for r in got]
    assert order == sorted(order)
    again = mixing.curriculum(frame.orderBy("text").repartition(3)).collect()
    key = lambda r: (r.doc_id or -1, r.source or "", r.text_hash, r.taken, tuple(r.times))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.curriculum(frame.limit(0)).count() == 0


def test_mix_repeats_whole_documents(spark):
    rows, frame = mix_table(spark)
    got = mixing.mix(frame).collect()
    count = defaultdict(int)
    for r in got:
        count[r.source] += len((r.text or "").split())
    sizes = defaultdict(int)
    for _, s, t, _ in rows:
        sizes[s] += len((t or "").split())
    for s, t in targets_by_rounds(sizes, 3).items():
        assert abs(count[s] - t) <= 60
    assert set(got[0].asDict()) == set(frame.columns)


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = corpus_pipeline.documents(spark, folder)
    odd = spark.createDataFrame([(90_001, "", None, None, 0), (90_002, "12 34 !!", "en", "s", 8), (90_003, None, None, "s", None)], docs.schema)
    now = docs.unionByName(odd)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, corpus_pipeline.store(stage(spark, now, folder), name)
        if name != "packing":
            assert now.columns == names
        if name == "language":
            assert {r.doc_id for r in now.collect()} == {r.doc_id for r in docs.collect()}
        if name == "line_dedup":
            assert now.count() == before.count()
            assert all(r.n_chars == len(r.text or "") for r in now.collect())
        if name == "near_dedup":
            assert now.count() <= before.count()
    pieces = now.collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in before.collect()}
    texts = {r.doc_id: r.text for r in before.collect()}
    plain = Tokenizer.from_file(PATH)
    whole = defaultdict(set)
    for r in pieces:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        whole[r.doc_id].add((r.start, bytes(r.ids)))
    for i, parts in whole.items():
        ids = np.frombuffer(b"".join(p for _, p in sorted(parts)), "<u4").tolist()
        assert ids == [*plain.encode(texts[i] or "", add_special_tokens=False).ids, 1]
    assert corpus_pipeline.run(spark, folder).count() > 0
