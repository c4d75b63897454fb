"""Spelling variants, dialogue repair and token files against plain versions, and the edge cases of their docstrings."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import dialogues, spelling, tokenfiles

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_variants(counts: dict[str, int]) -> dict[str, tuple]:
    """All pairs of words by their texts without one code point."""
    near: dict[str, set] = {w: set() for w in counts}
    shorter: dict[tuple, list] = {}
    for w in counts:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1 :]
            shorter.setdefault((i, cut), []).append(w)
            if cut in counts:
                near[w].add(cut)
                near[cut].add(w)
    for words in shorter.values():
        for a in words:
            near[a] |= {b for b in words if b != a}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-counts[o], o))
            if counts[best] >= 10 * counts[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def test_variants_against_all_pairs(spark):
    """Few letters, so that grams repeat and very many words are near; accents; chains of forms."""
    rng = random.Random(4)
    counts = {"".join(rng.choices("abé", k=rng.randint(7, 9))): rng.choice([2, 3, 40, 500, 7000]) for _ in range(900)}
    counts |= {"aaaaaaa": 2, "aaaaaaaa": 30, "aaaaaaaaa": 400, "ÿ" * 7: 2, "chained": 3, "chainxd": 40, "chaixxd": 500, "x" * 40: 9, "x" * 41: 100}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(7)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(vocabulary).collect()}
    assert got == plain_variants(counts)
    assert got["chained"][1] == "chaixxd"


def test_words_of_odd_texts(spark):
    """Nulls, empty and very long texts, repeated rows, columns with clashing names, runs that lose a code point."""
    long = "Wörterbuch " * 20_000 + "x" * 300_000
    data = [(1, long, "a"), (2, None, "b"), (3, "", None), (None, "Satzung, Satzung!", "c"), (4, "Ärzte÷Straßen STRASSEN", "d"), (4, "Ärzte÷Straßen STRASSEN", "d")]
    docs = spark.createDataFrame(data, "doc_id long, text string, word string").withColumn("n", F.lit(1)).withColumn("key", F.lit(2))
    for slip in (0, 3, 31):
        expected: dict[str, int] = {}
        for doc, text, _ in data:
            for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                run = run.translate(LOWER)
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                if slip and h % slip == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= 7:
                    expected[run] = expected.get(run, 0) + 1
        got = {r.word: r.n for r in spelling.words(docs, slip).collect()}
        assert got == {w: n for w, n in expected.items() if n >= 2}
    assert spelling.spelling_variants(docs.limit(0)).collect() == []


def plain_repair(codes: bytes) -> tuple[int, str]:
    """Forward over rows with the least (cost, letters) per state."""

    def closed(states):
        states = dict(states)
        for _ in range(3):
            for q, (cost, letters) in list(states.items()):
                to, found = dialogues.NEXT[q], (cost + 5, letters + "I")
                if to not in states or found < states[to]:
                    states[to] = found
        return states

    now = {0: (0, "")}
    for code in codes:
        initial, fault = divmod(code, 3)
        new: dict[int, tuple] = {}
        for q, (cost, letters) in closed(now).items():
            moves = [(q, 2, "D")]
            if fault != dialogues.LOST:
                more, to = (5 if fault == dialogues.CUT else 0), dialogues.NEXT[q]
                moves.append((to, 1 + more, "R"))
                if initial == to - 1:
                    moves.append((to, more, "K"))
                if initial == 0 and q == 0:
                    moves.append((1, more, "K"))
            for to, price, letter in moves:
                found = (cost + price, letters + letter)
                if to not in new or found < new[to]:
                    new[to] = found
        now = new
    return min(v for q, v in closed(now).items() if q in (0, 3))


def auction(codes: bytes, block: int) -> tuple[int, str]:
    parts = [codes[i : i + block] for i in range(0, len(codes), block)]
    ahead, exits = dialogues.END, []
    for part in reversed(parts):
        exits.append(ahead)
        costs = dialogues.block_costs(part)
        ahead = tuple(min(min(costs[4 * a + b] + ahead[b] for b in range(4)), dialogues.FAR) for a in range(4))
    state, out = dialogues.START, ""
    for part, after in zip(parts, reversed(exits)):
        layers = dialogues.layer_prices(part, after)
        leads = dialogues._exit_states(part, after)[state]
        for i, code in enumerate(part):
            letters, state = dialogues.follow(code, state, layers[i], layers[i + 1])
            out += letters
        assert state == leads
    return ahead[0], out + dialogues.closing(state)[0]


def test_auction_against_all_states():
    rng = random.Random(1)
    for _ in range(4000):
        codes = bytes(rng.choice([0, 1, 2, 3, 3, 5, 6, 6, 8, 4, 7, 9, 11]) for _ in range(rng.randint(1, 30)))
        expected = plain_repair(codes)
        assert auction(codes, 1000) == expected and auction(codes, 4) == expected


def plain_result(rows) -> tuple:
    """One conversation of (turn, role, text), already damaged."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, codes, blank, duplicate, truncated, illegal = set(), [], 0, 0, 0, 0
    for k, (_, role, text) in enumerate(rows):
        core = text.strip(" \t\n\x0b\x0c\r")
        fault = 0
        if not core:
            blank, fault = blank + 1, 1
        elif (role, text) in seen:
            duplicate, fault = duplicate + 1, 1
        elif core[-1] not in ".!?":
            truncated, fault = truncated + 1, 2
        seen.add((role, text))
        codes.append(3 * {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + fault)
        illegal += k > 0 and rows[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    cost, audit = plain_repair(bytes(codes)) if codes else (0, "")
    lines, state, at = [], 0, 0
    for letter in audit:
        if letter == "I":
            state = dialogues.NEXT[state]
            lines.append(dialogues.ROLES[state] + ":")
            continue
        _, role, text = rows[at]
        at += 1
        if letter == "R":
            state = dialogues.NEXT[state]
            lines.append(f"{dialogues.ROLES[state]}:{text}")
        elif letter == "K":
            state = 1 if role[:1] == "s" else dialogues.NEXT[state]
            lines.append(f"{role}:{text}")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("damaged", [False, True])
def test_repair_of_odd_conversations(spark, damaged):
    """A hot conversation over many blocks, nulls anywhere, repeated rows, other roles, long texts, clashing columns."""
    rng = random.Random(8)
    texts = ["Yes.", "No!", "cut", "", " \t", "Why?", "line\nline.", "é" * 3000 + "."]
    roles = ["user", "assistant", "system", "tool", "", "User"]
    data = [(7, t, roles[t % 2] if rng.random() < 0.8 else rng.choice(roles), f"{t} {rng.choice(texts)}" if rng.random() < 0.7 else rng.choice(texts)) for t in range(300)]
    data += [(c, rng.choice([None, rng.randint(-3, 9)]), rng.choice([*roles, None]), rng.choice([*texts, None])) for c in [None, *range(40)] for _ in range(rng.randint(1, 7))]
    data += data[-6:]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("x")).withColumn("conv", F.lit("y")).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in dialogues.repair(frame, damaged, rows_of_block=16).collect()}
    groups: dict = {c: [] for c, *_ in data}
    for conv, turn, role, text in data:
        role, text = " " if role is None else role, " " if text is None else text
        copies = 1
        if damaged:
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            copies = 0 if kind == 0 else 2 if kind == 3 else 1
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
        groups[conv] += [(turn, role, text)] * copies
    assert got == {c: plain_result(r) for c, r in groups.items()}


def test_repair_of_an_empty_table(spark):
    assert dialogues.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


@pytest.mark.parametrize("width", [2, 4])
def test_token_files_round_trip(spark, tmp_path, tokenizer, width):
    """Null, empty and very long texts, a repeated doc_id, a null one, extra columns; single documents by their index."""
    rng = random.Random(2)
    data = [(i, " ".join(f"word{rng.randint(0, 300)}" for _ in range(rng.randint(0, 60)))) for i in range(400)]
    data += [(1000, "Antidisestablishment " * 30_000), (1001, None), (1002, ""), (None, "no id"), (3, "again"), (-5, "negative")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("start", F.lit(1)).repartition(6)
    path = f"file://{tmp_path}/tokens"
    tokenfiles.write_tokens(docs, path, tokenizer[0], width=width)
    got = sorted(tokenfiles.read_tokens(spark, path).collect(), key=lambda r: r.start)
    ids = {}
    for doc, text in data:
        ids.setdefault(doc, []).append(tokenizer[1].encode(text or "", add_special_tokens=False).ids + [1])
    assert [r.doc_id for r in got] == sorted((d for d, _ in data), key=lambda d: (d is not None, d or 0))
    start = 0
    for r in got:
        found = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == start and r.n_tokens == len(found)
        ids[r.doc_id].remove(found)
        start += len(found)
    assert not any(ids.values())
    one = tokenfiles.read_tokens(spark, path, [1000, 3, 77777]).collect()
    assert sorted(r.doc_id for r in one) == [3, 3, 1000]
    manifest = spark.read.parquet(f"{path}/manifest.parquet")
    assert manifest.agg(F.sum("tokens")).first()[0] == start and {r.dictionary for r in manifest.collect()} == {hashlib.sha256((tmp_path / "tokens/dictionary").read_bytes()).hexdigest()}
    assert manifest.agg(F.sum("bytes")).first()[0] < start * width


def test_token_files_of_few_documents_and_damage(spark, tmp_path, tokenizer):
    empty = f"{tmp_path}/empty"
    tokenfiles.write_tokens(spark.createDataFrame([], "doc_id long, text string"), empty, tokenizer[0])
    assert tokenfiles.read_tokens(spark, empty).collect() == []
    few = f"{tmp_path}/few"
    tokenfiles.write_tokens(spark.createDataFrame([(1, "two words")], "doc_id long, text string"), few, tokenizer[0])
    assert [(r.doc_id, r.start, r.n_tokens) for r in tokenfiles.read_tokens(spark, few).collect()] == [(1, 0, 3)]
    (tmp_path / "few/dictionary").write_bytes(b"another")
    with pytest.raises(Exception, match="dictionary"):
        tokenfiles.read_tokens(spark, few).collect()
