"""Licence notices: a trained paragraph classifier with a calibrated unknown class, confirmed against templates.

Judged are single lines and windows of paragraphs.  A paragraph goes up to a line without a letter or digit, its lines
are joined, comment marks left out; wherever enough of the word pairs of a notice come within about twice the notice's
length there is a window, so a notice is found wrapped, inside a long line, and beside another family's.

Features are hashed word unigrams and bigrams, lower-cased.  A multinomial logistic
regression knows one class per licence family and ``unknown``.  It is trained on variants of the families' notices
(words left out, words around them) and, as unknown, on near misses and on a bounded sample of the corpus' own
paragraphs.  A held-out part sets the temperature and the least probability at which a family is believed.  A believed
family is confirmed if enough of the word pairs of one of its notices are in the line or window.

The model is the notices' features times the families and does not grow with the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.wordhash import BLOCK, constants, mix, text_bytes, word_hashes

FEATURE_BITS = 15
SAMPLE_PARAGRAPHS = 2000  # bound of the corpus sample for the unknown class
VARIANTS = 24
CONFIRM = 0.6  # share of a notice's word pairs that must be there
UNKNOWN = "unknown"
GNU = {"affero": "agpl", "lesser": "lgpl", "library": "lgpl"}  # the word behind "gnu" tells families with like notices apart

# Usual notices of licence families, as their texts give them.
NOTICES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Affero General Public License, version 3.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "mit": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
}
NEAR_MISSES = [
    "The driver showed a licence to the officer and went on.",
    "You need a fishing license to use this lake from May on.",
    "All rights reserved.",
    "The licence fee was raised by the council last year.",
    "He was granted permission to leave free of charge.",
    "A copy of the work was found in the library of the university.",
    "This version is under review and may be modified at any time.",
    "The terms of the contract were published in the public register.",
    "The foundation works with apache helicopters and free schools.",
    "Students of MIT released a paper under a new name.",
    "Creative people share their work in the commons every Friday.",
    "The general public was invited to the third session.",
]


def _paragraphs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, ends of all lines, number of each line's text, and the line's place in its text."""
    data, ends = text_bytes(column)
    breaks = np.flatnonzero(data == 10) + 1
    bounds = np.sort(np.concatenate([breaks, ends]), kind="stable")
    # a line starts at every text start and after every break; equal bounds are empty lines
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(np.searchsorted(breaks, ends, "right")) + 1)
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    return data, bounds, owner, place


def _features(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of words, then of pairs of neighbouring words of one line, and the line of each."""
    line = np.repeat(np.arange(len(counts)), counts)
    shift = np.uint64(64 - FEATURE_BITS)
    with np.errstate(over="ignore"):
        pairs = mix(hashes[:-1] * constants(1, 7)[0] + hashes[1:])
    same = line[:-1] == line[1:]
    numbers = np.concatenate([(hashes >> shift), (pairs[same] >> shift)]).astype(np.int64)
    return numbers, np.concatenate([line, line[:-1][same]])


def _feature_lists(texts: list[str]) -> list[np.ndarray]:
    data, ends = text_bytes(pa.array([t.replace("\n", " ") for t in texts], pa.string()))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    for at, counts, hashes, _, _ in word_hashes(data, ends):
        numbers, line = _features(hashes, counts)
        for k in range(len(counts)):
            out[at + k] = np.unique(numbers[line == k])
    return out


def pair_set(text: str) -> set[tuple[str, str]]:
    words = ["".join(c for c in w if c.isalnum() or c in ".-+") for w in text.lower().split()]
    words = [w.strip(".-") for w in words]
    words = [w for w in words if w]
    return set(zip(words, words[1:])) or {(w, "") for w in words}


_TEMPLATES = {family: [pair_set(n) for n in notices] for family, notices in NOTICES.items()}

_PAIRS = {family: set().union(*templates) for family, templates in _TEMPLATES.items()}


def resemblance(text: str, family: str) -> float:
    """The largest share of a notice's word pairs that the text has."""
    own = pair_set(text)
    return max(len(own & t) / len(t) for t in _TEMPLATES[family])


def confirmed(text: str, family: str, like: float) -> bool:
    if like < CONFIRM:
        return False
    named = {GNU[b] for a, b in pair_set(text) if a == "gnu" and b in GNU}
    return family in named if family in GNU.values() else family != "gpl" or not named


# Words told apart by letters and digits alone; other characters above ASCII are left in.
_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[48:58] = _WORD_BYTES[65:91] = _WORD_BYTES[97:123] = _WORD_BYTES[128:] = True
_BLANKS = np.zeros(256, bool)
_BLANKS[[9, 10, 11, 12, 13, 32]] = True
_LEADING = " \t\r*#/;|!>%-"
_MARKS = re.compile(r"\n[\s*#/;|!>%-]*")


def _pair_hashes(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: the first text, word counts, hashes of the words' letters and digits, and the words' bytes."""
    keep = _WORD_BYTES[data] | _BLANKS[data]
    left = np.flatnonzero(keep)
    for at, counts, hashes, starts, stops in word_hashes(data[left], np.concatenate([[0], np.cumsum(keep)])[ends]):
        yield at, counts, hashes, left[starts], left[stops - 1] + 1


def _joined(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(hashes[:-1] * constants(1, 7)[0] + hashes[1:])


class _Notices:
    """Word pairs of all notices: sorted hashes, and for each the numbers of its notices."""

    def __init__(self):
        texts = [(family, n) for family in sorted(NOTICES) for n in NOTICES[family]]
        self.family = [family for family, _ in texts]
        self.pairs, self.words = [], []
        for _, counts, hashes, _, _ in _pair_hashes(*text_bytes(pa.array([n for _, n in texts], pa.string()))):
            edges = np.concatenate([[0], np.cumsum(counts)])
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                self.pairs.append(np.unique(_joined(hashes[low:high])))
                self.words.append(high - low)
        self.need = np.array([CONFIRM * len(p) for p in self.pairs])
        flat = np.concatenate(self.pairs)
        notice = np.repeat(np.arange(len(self.pairs)), [len(p) for p in self.pairs])
        order = np.lexsort((notice, flat))
        self.notice = notice[order]
        self.keys, self.heads, self.sizes = np.unique(flat[order], return_index=True, return_counts=True)

    def windows(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text number, first byte, end byte) of the windows, the longer one of each two first."""
        for at, counts, hashes, starts, stops in _pair_hashes(data, ends):
            if len(hashes) < 2:
                continue
            pair = _joined(hashes)
            place = np.searchsorted(self.keys, pair)
            place[place == len(self.keys)] = 0
            hit = np.flatnonzero(self.keys[place] == pair)
            owner = np.repeat(np.arange(at, at + len(counts)), counts)
            hit = hit[owner[hit] == owner[hit + 1]]
            if not len(hit):
                continue
            place = place[hit]
            # a paragraph ends where two line breaks stand between words with nothing but blanks and marks
            gap = np.flatnonzero(starts[1:] > stops[:-1] + 1)
            low, high = int(starts[0]), int(stops[-1])
            breaks = np.flatnonzero(data[low:high] == 10) + low
            apart = np.zeros(len(hashes), np.int64)
            apart[gap + 1] = np.searchsorted(breaks, starts[gap + 1]) - np.searchsorted(breaks, stops[gap]) > 1
            paragraph = np.cumsum(apart)
            whole = paragraph[hit] == paragraph[hit + 1]
            hit, place = hit[whole], place[whole]
            sizes = self.sizes[place]
            row = np.repeat(np.arange(len(hit)), sizes)
            notice = self.notice[np.repeat(self.heads[place] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(row))]
            block = paragraph[hit] * (len(ends) + 1) + owner[hit]
            group, number = np.unique(block, return_inverse=True)
            own = number[row] * len(self.pairs) + notice
            distinct = np.unique(own * len(self.keys) + place[row]) // len(self.keys)
            keys, found = np.unique(distinct, return_counts=True)
            keys = keys[found >= self.need[keys % len(self.pairs)]]
            chosen = np.flatnonzero(np.isin(own, keys))
            chosen = chosen[np.argsort(own[chosen], kind="stable")]
            for part in np.split(chosen, np.flatnonzero(np.diff(own[chosen])) + 1):
                if len(part):
                    n = int(notice[part[0]])
                    for low, high in self._spans(hit[row[part]].tolist(), place[row[part]].tolist(), n):
                        yield int(owner[low]), int(starts[low]), int(stops[high + 1])

    def _spans(self, at: list[int], pair: list[int], notice: int) -> Iterator[tuple[int, int]]:
        """First and last pair of the least windows with enough different pairs, each after a wider one."""
        need, limit = self.need[notice], 2 * self.words[notice] + 8
        held: Counter = Counter()
        low = high = 0
        while high < len(at):
            held[pair[high]] += 1
            high += 1
            while at[high - 1] - at[low] > limit or held[pair[low]] > 1:
                held[pair[low]] -= 1
                held += Counter()
                low += 1
            if len(held) >= need:
                wide = high
                while wide < len(at) and at[wide] - at[low] <= limit:
                    wide += 1
                first = low
                while len(held) - (held[pair[first]] == 1) >= need:
                    held[pair[first]] -= 1
                    held += Counter()
                    first += 1
                yield at[low], at[wide - 1]
                yield at[low], at[high - 1]
                yield at[first], at[high - 1]
                held.clear()
                low = high


_FOUND_BY = _Notices()


def _windows(data: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, str]]:
    """(text number, first byte, end byte, text) of the windows, from white space to white space, comment marks left out."""
    out, seen = [], set()
    at = 0
    while at < len(ends) - 1:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, "right")) - 1)
        base = int(ends[at])
        for n, low, high in _FOUND_BY.windows(data[base : ends[stop]], ends[at : stop + 1] - base):
            n, low, high = n + at, low + base, high + base
            while low > ends[n] and not _BLANKS[data[low - 1]]:
                low -= 1
            while high < ends[n + 1] and not _BLANKS[data[high]]:
                high += 1
            if (low, high) not in seen:
                seen.add((low, high))
                out.append((n, low, high, _MARKS.sub(" ", data[low:high].tobytes().decode())))
        at = stop
    return out


def sample_paragraphs(docs: DataFrame, count: int = SAMPLE_PARAGRAPHS) -> list[np.ndarray]:
    """Features of the ``count`` different paragraphs whose hashes are the least; equal for equal corpora.

    A first pass counts the paragraphs.  Only those whose hash is small enough for four times ``count`` of them are then
    made distinct and ordered, so what meets in one task does not grow with the corpus.  Many copies of few paragraphs
    may leave fewer than ``count``.
    """
    line = F.col("line")
    split = F.split(F.col("text").cast("string"), "\n", -1)
    total = docs.agg(F.sum(F.size(split)).alias("n")).first()["n"] or 0
    share = min(1.0, 4 * count / max(1, total))
    least = min(2**63 - 1, int((2 * share - 1) * 2**63))
    lines = docs.select(F.explode(split).alias("line")).filter(F.length("line") > 0)
    hashed = lines.select(F.xxhash64(line, F.lit("sample")).alias("h"), line.alias("text")).filter(F.col("h") <= least)
    chosen = hashed.dropDuplicates(["h", "text"]).orderBy("h", "text").limit(count)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            best = [max(resemblance(t, f) for f in NOTICES) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(_feature_lists(texts), pa.list_(pa.int64())), pa.array(best)], names=["f", "best"])

    rows = chosen.mapInArrow(run, "f array<bigint>, best double").filter(F.col("best") < CONFIRM / 2).select("f").toArrow()
    return [np.array(f, np.int64) for f in rows["f"].to_pylist()]


def _variants(seed: int = 5) -> tuple[list[str], list[str]]:
    """Training texts and their families, made of the notices and the near misses."""
    draw = np.random.default_rng(seed)
    around = " ".join(NEAR_MISSES).lower().split()
    texts, families = [], []

    def add(text: str, family: str) -> None:
        words = text.split()
        for k in range(VARIANTS):
            kept = [w for w in words if k == 0 or draw.random() > 0.08]
            before = draw.choice(around, draw.integers(0, 6)).tolist() if k % 3 == 1 else []
            after = draw.choice(around, draw.integers(0, 12)).tolist() if k % 3 == 2 else []
            texts.append(" ".join(before + kept + after))
            families.append(family)

    for family, notices in NOTICES.items():
        for notice in notices:
            add(notice, family)
    for miss in NEAR_MISSES:
        add(miss, UNKNOWN)
    return texts, families


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Classifier:
    """Families (unknown last), weights (features x classes), bias, temperature, and the least believed probability."""

    def __init__(self, unknown: list[np.ndarray], rounds: int = 150, rate: float = 6.0):
        self.classes = [*sorted(NOTICES), UNKNOWN]
        texts, families = _variants()
        rows = _feature_lists(texts) + unknown
        goal = np.array([self.classes.index(f) for f in families] + [len(NOTICES)] * len(unknown))
        keep = np.array([len(r) > 0 for r in rows])
        rows, goal = [r for r, k in zip(rows, keep) if k], goal[keep]
        held = np.arange(len(rows)) % 4 == 3
        self.weights = np.zeros((1 << FEATURE_BITS, len(self.classes)))
        self.bias = np.zeros(len(self.classes))
        self._fit([r for r, h in zip(rows, held) if not h], goal[~held], rounds, rate)
        scores = self._logits([r for r, h in zip(rows, held) if h])
        truth = goal[held]
        heats = [2.0**t for t in np.arange(-4, 2.5, 0.5)]
        self.temperature = min(heats, key=lambda t: -np.log(_softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean())
        believed = _softmax(scores / self.temperature)[:, :-1].max(axis=1)[truth == len(NOTICES)]
        self.least = max(0.5, float(np.quantile(believed, 0.995)) if len(believed) else 0.5)

    def _logits(self, rows: list[np.ndarray]) -> np.ndarray:
        flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
        sums = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0)
        return sums / np.sqrt(sizes)[:, None] + self.bias

    def _fit(self, rows: list[np.ndarray], goal: np.ndarray, rounds: int, rate: float) -> None:
        flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
        line, scale = np.repeat(np.arange(len(rows)), sizes), np.sqrt(sizes)
        # classes count alike, whatever their number of texts
        balance = 1 / np.bincount(goal, minlength=len(self.classes))[goal]
        balance /= balance.sum()
        for _ in range(rounds):
            slope = _softmax(self._logits(rows))
            slope[np.arange(len(goal)), goal] -= 1
            slope *= balance[:, None]
            self.bias -= rate * slope.sum(axis=0)
            part = (slope / scale[:, None])[line]
            for c in range(len(self.classes)):
                self.weights[:, c] -= rate * (np.bincount(flat, part[:, c], 1 << FEATURE_BITS) + 1e-5 * self.weights[:, c])

    def judge(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For lines given by their words: the likeliest family and its probability."""
        numbers, line = _features(hashes, counts)
        keys = np.unique(line << FEATURE_BITS | numbers)
        line, numbers = keys >> FEATURE_BITS, keys & ((1 << FEATURE_BITS) - 1)
        sizes = np.bincount(line, minlength=len(counts))
        there = np.flatnonzero(sizes)
        shares = np.zeros((len(counts), len(self.classes)))
        shares[:, -1] = 1
        if len(there):
            starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
            sums = np.add.reduceat(self.weights[numbers], starts, axis=0) / np.sqrt(sizes[there])[:, None] + self.bias
            shares[there] = _softmax(sums / self.temperature)
        best = shares[:, :-1].argmax(axis=1)
        return best, shares[np.arange(len(best)), best]


    def judge_texts(self, texts: list[str]) -> Iterator[tuple[int, int, float]]:
        """Of each believed text its number, family and probability."""
        for at, counts, hashes, _, _ in word_hashes(*text_bytes(pa.array(texts, pa.string()))):
            best, share = self.judge(hashes, counts)
            for k in np.flatnonzero(share >= self.least).tolist():
                yield at + k, int(best[k]), float(share[k])


_HITS = "array<struct<line: int, family: string, probability: double, resemblance: double, confirmed: boolean>>"


def scan(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_paragraphs, licences, hits.

    ``hits``: every line whose family is believed, with the line's number from 0, the probability, and the largest share
    of a notice's word pairs in it; and every window that confirms a family, unless a confirmed hit of that family
    overlaps it, with the number of its first line.  ``licences``: the confirmed families, sorted.  ``n_paragraphs``
    counts lines.  A null text has one empty line and no hits.  Every row is judged by its text alone.
    """
    model = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = model.value
        kind = pa.list_(
            pa.struct(
                [("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("resemblance", pa.float64()), ("confirmed", pa.bool_())]
            )
        )
        for batch in batches:
            data, bounds, owner, place = _paragraphs(batch.column("text"))
            hits: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            held: dict[tuple[int, str], list[tuple[int, int]]] = {}
            sure_lines: list[tuple[int, int, int, dict]] = []
            for at, counts, hashes, _, _ in word_hashes(data, bounds):
                best, share = judge.judge(hashes, counts)
                for k in np.flatnonzero(share >= judge.least).tolist():
                    n = at + k
                    text = data[bounds[n] : bounds[n + 1]].tobytes().decode()
                    family = judge.classes[int(best[k])]
                    like = resemblance(text, family)
                    hit = {"line": int(place[n]), "family": family, "probability": float(share[k]), "resemblance": like}
                    hits[int(owner[n])].append(hit | {"confirmed": confirmed(text, family, like)})
                    if hits[int(owner[n])][-1]["confirmed"]:
                        low = int(bounds[n]) + len(text) - len(text.lstrip(_LEADING))  # what goes is ASCII
                        sure_lines.append((int(owner[n]), low, low + len(text.strip(_LEADING + "\n").encode()), hits[int(owner[n])][-1]))
                        held.setdefault((int(owner[n]), family), []).append((int(bounds[n]), int(bounds[n + 1])))
            ends = text_bytes(batch.column("text"))[1]
            windows = _windows(data, ends)
            sure_windows: dict[int, list[tuple[int, int, str, float, float]]] = {}
            for k, best, share in judge.judge_texts([w[3] for w in windows]) if windows else ():
                n, low, high, text = windows[k]
                family = judge.classes[best]
                like = resemblance(text, family)
                if confirmed(text, family, like):
                    sure_windows.setdefault(n, []).append((low, high, family, share, like))

            def part(n: int, low: int, high: int, family: str, like: float) -> bool:
                """Nothing but a part of another family's better match, such as the start of a longer name."""
                over = {f for a, b, f, _, s in sure_windows.get(n, ()) if a <= low and high <= b and f != family and s > like}
                own = pair_set(_MARKS.sub(" ", data[low:high].tobytes().decode())) & _PAIRS[family] if over else set()
                return any(own <= _PAIRS[f] for f in over)

            for n, low, high, hit in sure_lines:
                hit["confirmed"] = not part(n, low, high, hit["family"], hit["resemblance"])
            for n, found in sure_windows.items():
                for low, high, family, share, like in found:
                    spans = held.setdefault((n, family), [])
                    if not part(n, low, high, family, like) and not any(a < high and low < b for a, b in spans):
                        spans.append((low, high))
                        line = int(place[np.searchsorted(bounds, low, "right") - 1])
                        hits[n].append({"line": line, "family": family, "probability": share, "resemblance": like, "confirmed": True})
            for own in hits:
                own.sort(key=lambda h: (h["line"], not h["confirmed"], h["family"]))
            lines = np.bincount(owner, minlength=batch.num_rows)
            found = [sorted({h["family"] for h in own if h["confirmed"]}) for own in hits]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(hits, kind)],
                names=["doc_id", "n_paragraphs", "licences", "hits"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_paragraphs long, licences array<string>, hits {_HITS}")


def license_scan(docs: DataFrame) -> DataFrame:
    """``scan`` with a classifier whose unknown class has seen a sample of these documents' paragraphs."""
    return scan(docs, Classifier(sample_paragraphs(docs)))
