"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs the labelers, a classifier decides.

1. A scan of whole texts finds the base spans (four patterns with their checks) and looser candidates: addresses spelled
   out with "at" and "dot", telephone numbers without a plus, and base matches that failed their check.
2. Regex, gazetteer and context labelers vote for, against or not at all on every candidate.
3. Votes are counted per (kind, votes, features) over the looser candidates of the whole corpus; base spans stay anyway,
   and their number must not decide about others.  These patterns, whose number is bounded by the labelers and the
   feature buckets and not by the corpus, go to the driver: expectation-maximisation (Dawid and Skene) estimates how
   reliable each labeler is per kind and how likely each pattern is personal data.  What a vote means is anchored by
   as many made votes as there are real ones, so equal mixtures of candidates are judged alike whatever their number.
4. A logistic regression per kind over votes and features learns those likelihoods.  Candidates that it finds likely
   enough and that do not overlap a base span are added to the base spans.

All scans are linear in the text: a pattern never starts twice inside the same run of its characters.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.work import store

KINDS = ("email", "ip", "card", "phone")
CERTAIN = 0.9
NEAR = 40  # characters before a span in which context words count
ANCHOR = 0.85  # share of right votes that a labeler is taken to give before its votes are seen

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9][0-9.]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPELLED = re.compile(r"(?<=[A-Za-z0-9]) ?(?:\((?:at|AT)\)|\[(?:at|AT)\]| at ) ?([A-Za-z0-9-]{1,63}) ?(?:\((?:dot|DOT)\)|\[(?:dot|DOT)\]| dot ) ?[A-Za-z]{2,12}\b")
_BRACKETED = re.compile(r" ?(?:\((?:at|AT)\)|\[(?:at|AT)\]) ?")
_LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])")

# Gazetteers and context words: plain word lists.
ENDINGS = frozenset("com org net edu gov info biz io de fr es uk it nl eu us ca au jp cn ru br ch at se no pl in mx".split())
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "60", "62", "64", "65")
FOR = {
    "email": "email e-mail mail contact correo courriel kontakt write".split(),
    "ip": "ip host address server adresse client login".split(),
    "card": "card visa mastercard amex credit karte carte tarjeta payment".split(),
    "phone": "phone tel telephone call fax mobile telefon téléphone teléfono cell".split(),
}
AGAINST = "version isbn issn invoice order article release figure page doi build".split()
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[-1::-2]) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base spans in order, and of the matches that failed their check."""
    good: list[tuple[int, int, int]] = []
    failed: list[tuple[int, int, int]] = []
    if "@" in text:
        good += [(a, 0, b) for a, b in _emails(text)]
    for run in _DOTTED.finditer(text):
        if run.group().count(".") >= 3:
            for m in _IP.finditer(text, run.start(), run.end()):
                fits = all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))
                (good if fits else failed).append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        (good if 12 <= len(digits) <= 19 and luhn(digits) else failed).append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            count = sum(c.isdigit() for c in m.group())
            (good if 9 <= count <= 15 else failed).append((m.start(), 3, m.end()))
    good.sort()
    return good, failed


def _loose_spans(text: str) -> Iterator[tuple[int, int, int]]:
    lowered = "dot" in text or "DOT" in text
    if lowered:
        for m in _SPELLED.finditer(text):
            start = m.start()
            while start > 0 and m.start() - start < 64 and text[start - 1] in _LOCAL:
                start -= 1
            yield start, 0, m.end()
    for m in _LOOSE_PHONE.finditer(text):
        yield m.start(), 3, m.end()


def _vote(yes: bool, no: bool = False) -> str:
    return "+" if yes else "-" if no else "0"


def votes(text: str, start: int, kind: int, end: int, base: bool, failed: bool) -> str:
    """One sign per labeler: base pattern, check, usual layout, gazetteer, context, edges, placeholder values."""
    body = text[start:end]
    digits = "".join(c for c in body if "0" <= c <= "9")
    before = [w.lower() for w in _WORDS.findall(text[max(0, start - NEAR) : start])]
    previous, following = text[start - 1 : start], text[end : end + 1]
    name = KINDS[kind]
    # brackets are no ordinary writing; plain words "at" and "dot" may be prose
    address = body if base else _BRACKETED.sub("@", body, count=1)
    layout = {
        "email": address.count("@") == 1 and ".." not in address and address[0] not in ".-%+@",
        "ip": all(p == str(int(p[-4:])) for p in body.split(".")) if name == "ip" else False,
        "card": len(digits) in (15, 16),
        "phone": 10 <= len(digits) <= 13,
    }[name]
    known = {
        "email": re.split(r"[ .)\]]", body)[-1].lower() in ENDINGS,
        "ip": False,
        "card": digits.startswith(ISSUERS),
        "phone": len(digits) >= 10 and digits[-10] not in "01" and digits[-7] not in "01",
    }[name]
    placeholder = len(set(digits)) == 1 if digits else False
    return "".join(
        (
            _vote(base),
            _vote(base and name in ("ip", "card"), failed),
            _vote(layout, not layout and name != "email"),
            _vote(known, name == "card" and not known),
            _vote(any(w in FOR[name] for w in before), any(w in AGAINST for w in before)),
            _vote(False, previous.isalnum() or following.isalnum()),
            _vote(False, placeholder),
        )
    )


def features(text: str, start: int, end: int) -> str:
    """Bucketed shape: length, share of digits, and the kinds of the neighbouring characters."""
    body = text[start:end]

    def side(c: str) -> str:
        return "e" if not c else "s" if c.isspace() else "a" if c.isalnum() else "p"

    share = sum("0" <= c <= "9" for c in body) * 4 // max(1, len(body))
    return f"{min(7, len(body) // 6)}{share}{side(text[start - 1 : start])}{side(text[end : end + 1])}"


_FOUND = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base array<struct<start: long, kind: int, end: long>>, "
    "candidates array<struct<start: long, kind: int, end: long, base: boolean, votes: string, features: string>>"
)


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = [("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]
    kinds = {
        "base": pa.list_(pa.struct(span)),
        "candidates": pa.list_(pa.struct([*span, ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.string())])),
    }
    for batch in batches:
        out: dict[str, list] = {"base": [], "candidates": []}
        counts: list[list[int]] = [[], [], [], []]
        for text in batch.column("text").to_pylist():
            text = text or ""
            good, failed = base_spans(text)
            held = {(a, k, b) for a, k, b in good}
            every = [(s, True, False) for s in good] + [(s, False, True) for s in failed]
            every += [(s, False, False) for s in _loose_spans(text) if s not in held]
            out["base"].append([{"start": a, "kind": k, "end": b} for a, k, b in good])
            out["candidates"].append(
                [
                    {"start": a, "kind": k, "end": b, "base": base, "votes": votes(text, a, k, b, base, fail), "features": features(text, a, b)}
                    for (a, k, b), base, fail in every
                ]
            )
            for k, own in enumerate(counts):
                own.append(sum(s[1] == k for s in good))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], *[pa.array(out[c], kinds[c]) for c in ("base", "candidates")]],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "candidates"],
        )


def reliabilities(kind: np.ndarray, ballots: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Dawid-Skene EM on patterns: the probability that each is personal data.

    ``ballots``: patterns x labelers with 0 (none), 1 (for), 2 (against).  Starts from the share of votes that are for.
    A vote that is not given says nothing, both classes are equally likely beforehand, and a labeler's votes are joined
    by as many made ones, of which ``ANCHOR`` are right: labelers of which all votes are alike then keep their meaning,
    and the result depends on shares of the weights alone.
    """
    good, bad = (ballots == 1).sum(axis=1), (ballots == 2).sum(axis=1)
    likely = (good + 0.5) / (good + bad + 1)
    for _ in range(rounds):
        new = likely.copy()
        for k in np.unique(kind):
            own = kind == k
            w1, w0 = weight[own] * likely[own], weight[own] * (1 - likely[own])
            odds = np.zeros(own.sum())
            for j in range(ballots.shape[1]):
                b = ballots[own, j]
                made = weight[own][b > 0].sum()
                if made == 0:
                    continue
                yes = np.bincount(b, w1, 3)[1:] + made * np.array([ANCHOR, 1 - ANCHOR])
                no = np.bincount(b, w0, 3)[1:] + made * np.array([1 - ANCHOR, ANCHOR])
                odds += np.r_[0.0, np.log(yes / yes.sum()) - np.log(no / no.sum())][b]
            new[own] = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - likely).max(initial=0) < 1e-6:
            return new
        likely = new
    return likely


def _inputs(kind: int, ballot: str, shape: str) -> list[str]:
    return [
        f"kind {kind}",
        *[f"vote {j} {v} {kind}" for j, v in enumerate(ballot)],
        *[f"shape {j} {v} {kind}" for j, v in enumerate(shape)],
    ]


def span_classifier(patterns: list[dict], rounds: int = 50) -> dict[str, float]:
    """Weights of a logistic regression per kind over votes and features, fitted to the EM's likelihoods."""
    if not patterns:
        return {}
    kinds = np.array([p["kind"] for p in patterns])
    ballots = np.array([["0+-".index(v) for v in p["votes"]] for p in patterns])
    weights = np.array([p["n"] for p in patterns], float)
    goals = reliabilities(kinds, ballots, weights)
    out: dict[str, float] = {}
    for k in np.unique(kinds).tolist():
        rows = np.flatnonzero(kinds == k)
        inputs = [_inputs(k, patterns[r]["votes"], patterns[r]["features"]) for r in rows.tolist()]
        names = sorted({n for own in inputs for n in own})
        place = {n: i for i, n in enumerate(names)}
        x = np.zeros((len(rows), len(names)))
        for i, own in enumerate(inputs):
            x[i, [place[n] for n in own]] = 1
        share = np.log1p(weights[rows])  # a frequent pattern counts more, but must not drown the others
        out.update(zip(names, _logistic(x, share / share.sum(), goals[rows], rounds).tolist()))
    return out


def _logistic(x: np.ndarray, share: np.ndarray, goal: np.ndarray, rounds: int, ridge: float = 1e-6) -> np.ndarray:
    """Newton's method with halved steps."""

    def loss(theta: np.ndarray) -> float:
        z = x @ theta
        return float(share @ (np.logaddexp(0, z) - goal * z) + ridge / 2 * theta @ theta)

    theta = np.zeros(x.shape[1])
    now = loss(theta)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (share * (p - goal)) + ridge * theta
        step = np.linalg.solve((x.T * (share * p * (1 - p))) @ x + ridge * np.eye(len(theta)), slope)
        size = 1.0
        while size > 1e-6 and (then := loss(theta - size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - then < 1e-12:
            break
        theta, now = theta - size * step, then
    return theta


class Taken:
    """Places of a text that spans hold: disjoint stretches in order, looked up by bisection."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, _, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def free(self, start: int, end: int) -> bool:
        at = bisect.bisect_right(self.ends, start)
        return at == len(self.starts) or self.starts[at] >= end

    def add(self, start: int, end: int) -> None:
        """``start`` to ``end`` must be free."""
        at = bisect.bisect_right(self.ends, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


def personal_data(docs: DataFrame, certain: float = CERTAIN) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, base, spans, added.

    ``base`` and ``spans`` are comma-joined ``kind:start:end`` in code points, by start and then by kind; ``spans`` has
    the base spans and those that the classifier adds, of which ``added`` is the number.  A null text is empty.  Rows are
    judged one by one, whatever their doc_id; an empty table gives an empty table.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = store(rows.mapInArrow(_scan, _FOUND), "spans")
    patterns = (
        found.select(F.explode("candidates").alias("c"))
        .filter("not c.base")
        .groupBy("c.kind", "c.votes", "c.features")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("kind", "votes", "features")
    )
    weights = span_classifier([r.asDict() for r in patterns.collect()])

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @functools.lru_cache(maxsize=10_000)
        def personal(kind: int, ballot: str, shape: str) -> bool:
            score = sum(weights.get(n, 0.0) for n in _inputs(kind, ballot, shape))
            return 1 / (1 + np.exp(-score)) >= certain

        for batch in batches:
            base_text, spans_text, digests, added = [], [], [], []
            for base, candidates in zip(batch.column("base").to_pylist(), batch.column("candidates").to_pylist()):
                held = [(s["start"], s["kind"], s["end"]) for s in base]
                taken, room = list(held), Taken(held)
                for c in candidates:
                    if not c["base"] and room.free(c["start"], c["end"]) and personal(c["kind"], c["votes"], c["features"]):
                        room.add(c["start"], c["end"])
                        taken.append((c["start"], c["kind"], c["end"]))
                line = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(held))
                base_text.append(line)
                digests.append(hashlib.sha256(line.encode()).hexdigest())
                spans_text.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(taken)))
                added.append(len(taken) - len(held))
            kept = [batch.column(c) for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(digests, pa.string()), pa.array(base_text, pa.string()), pa.array(spans_text, pa.string()), pa.array(added, pa.int64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "spans", "added"],
            )

    return found.mapInArrow(
        decide,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, spans string, added long",
    )
