"""Languages of a text as a mixture, by expectation-maximisation over letter n-gram likelihoods.

Training counts the letter trigrams of every labelled text per language, in hash buckets, as one distributed sum.  The
model is a table of smoothed log-probabilities (buckets x languages), the only thing that is broadcast.

A text is a mixture of languages: the EM estimates the shares under which its trigrams are likeliest.  The set of
languages is then cut down: the language with the least share goes if the likelihood without it, less a penalty that
grows with the number of languages and the logarithm of the number of trigrams, is higher.  Texts of a block go through
each step together; memory depends on the block and on the longest text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.wordhash import text_bytes
from corpusloom.llm.work import lean

BUCKET_BITS = 16
SMOOTHING = 0.5
PENALTY = 4.0  # times half a logarithm: neighbouring trigrams overlap, so their likelihoods count about thrice
UNKNOWN = "und"
STILL = 1e-4  # a text's EM stops when no share moves by this
ROUNDS = 200
BLOCK = 1 << 18
LETTER = r"\p{L}"

_SPACE = 32
_LETTERS = np.full(256, _SPACE, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def held_out(doc_id: Column) -> Column:
    """The documents that training must not see: crc32 of the id as text leaves 1 modulo 3; a null id is not one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _trigrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For blocks of texts: first text, end text, bucket and text number of every trigram.

    Everything but letters is a space, a text is surrounded by spaces, and trigrams with a space in the middle are left
    out.  A text longer than a block is a block of its own.
    """
    data, ends = text_bytes(column)
    at, n = 0, len(ends) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, "right")) - 1)
        sizes = np.diff(ends[at : stop + 1])
        owner = np.repeat(np.arange(at, stop), sizes + 2)
        letters = np.full(len(owner), _SPACE, np.uint8)
        inner = np.ones(len(owner), bool)
        heads = np.cumsum(sizes + 2) - (sizes + 2)
        inner[heads] = False
        inner[heads + sizes + 1] = False
        letters[inner] = _LETTERS[data[ends[at] : ends[stop]]]
        wide = letters.astype(np.uint32)
        code = wide[:-2] | (wide[1:-1] << np.uint32(8)) | (wide[2:] << np.uint32(16))
        real = (letters[1:-1] != _SPACE) & (owner[:-2] == owner[2:])
        code = code[real]
        bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
        yield at, stop, bucket.astype(np.int64), owner[:-2][real]
        at = stop


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) summed over all rows of ``docs`` (lang, text) with a language and a text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column("lang").to_pylist(), object)
            known, places = np.unique(names.astype(str), return_inverse=True)
            for _, _, bucket, owner in _trigrams(batch.column("text")):
                both = np.bincount(places[owner] << BUCKET_BITS | bucket, minlength=len(known) << BUCKET_BITS)
                for name, counts in zip(known.tolist(), both.reshape(len(known), -1)):
                    if counts.any():
                        sums[name] = sums[name] + counts if name in sums else counts
        for name, counts in sums.items():
            there = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(there), pa.string()), pa.array(there.astype(np.int32)), pa.array(counts[there].astype(np.int64))],
                names=["lang", "bucket", "n"],
            )

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    each = rows.filter("lang is not null and text is not null").mapInArrow(lean(run), "lang string, bucket int, n long")
    return each.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, in order of their names, and log-probabilities (languages x buckets).

    What comes to the driver has languages x buckets rows at most, whatever the corpus.
    """
    table = trigram_counts(docs).toArrow()
    names = sorted(set(table["lang"].to_pylist()))
    counts = np.zeros((len(names), 1 << BUCKET_BITS))
    rows = np.searchsorted(np.array(names, object), np.array(table["lang"].to_pylist(), object)) if names else []
    if names:
        counts[rows, table["bucket"].to_numpy()] = table["n"].to_numpy()
    smoothed = counts + SMOOTHING
    return names, np.log(smoothed / smoothed.sum(axis=1, keepdims=True))


def _starts(owner: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])


def _expect(p: np.ndarray, count: np.ndarray, owner: np.ndarray, share: np.ndarray, rounds: int):
    """EM rounds from ``share`` (texts x languages, zero for absent ones): new shares and log-likelihoods.

    Every text stops by itself, when none of its shares moves by ``STILL`` any more, and its rows are added up apart from
    those of others: the result of a text does not depend on its neighbours.
    """
    share = share.copy()
    live = np.arange(len(share))
    rows, n, of, starts = p, count, owner, _starts(owner)
    total = np.add.reduceat(count, starts)
    for _ in range(rounds):
        now = share[live]
        weight = rows * now[of]
        weight *= (n / weight.sum(axis=1))[:, None]
        share[live] = np.add.reduceat(weight, starts, axis=0) / total[:, None]
        moving = np.abs(share[live] - now).max(axis=1) >= STILL
        if not moving.any():
            break
        if not moving.all():
            stay = moving[of]
            live, total = live[moving], total[moving]
            rows, n, of = rows[stay], n[stay], (np.cumsum(moving) - 1)[of[stay]]
            starts = _starts(of)
    likely = np.add.reduceat(count * np.log((p * share[owner]).sum(axis=1)), _starts(owner))
    return share, likely


def mixture(bucket: np.ndarray, owner: np.ndarray, texts: int, logp: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Shares (texts x languages) of ``texts`` texts; a text without trigrams has shares of 0."""
    shares = np.zeros((texts, len(logp)))
    if not len(bucket):
        return shares
    keys, count = np.unique(owner << BUCKET_BITS | bucket, return_counts=True)
    owner, bucket = keys >> BUCKET_BITS, keys & ((1 << BUCKET_BITS) - 1)
    there, owner = np.unique(owner, return_inverse=True)
    p = logp.T[bucket]
    p = np.exp(p - p.max(axis=1, keepdims=True))
    count = count.astype(float)

    total = np.add.reduceat(count, _starts(owner))
    share = np.full((len(there), len(logp)), 1 / len(logp))
    share, likely = _expect(p, count, owner, share, rounds)
    # a language that explains less than one trigram cannot pay its penalty
    faint = (share * total[:, None] < 1) & (share < share.max(axis=1, keepdims=True))
    share[faint] = 0
    share /= share.sum(axis=1, keepdims=True)
    live = np.arange(len(there))
    while True:
        live = live[(share[live] > 0).sum(axis=1) > 1]
        if not len(live):
            break
        chosen = np.zeros(len(there), bool)
        chosen[live] = True
        rows = chosen[owner]
        renumber = np.cumsum(chosen) - 1
        sub_p, sub_count, sub_owner = p[rows], count[rows], renumber[owner[rows]]
        now, now_likely = _expect(sub_p, sub_count, sub_owner, share[live], 2)
        trial = now.copy()
        trial[np.arange(len(live)), np.where(now > 0, now, np.inf).argmin(axis=1)] = 0
        trial /= trial.sum(axis=1, keepdims=True)
        trial, trial_likely = _expect(sub_p, sub_count, sub_owner, trial, rounds)
        better = trial_likely + PENALTY * 0.5 * np.log(total[live] + 1) > now_likely
        share[live] = np.where(better[:, None], trial, now)
        live = live[better]
    shares[there] = share
    return shares


def predict(docs: DataFrame, names: list[str], logp: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score, shares) for each row of ``docs`` (doc_id, text).

    ``score`` is the share of the predicted language, ``shares`` all languages of the chosen set.  A null text, one
    without a letter, and any text if no language was learned is ``und`` with score 0.  Ties go to the first name.
    """
    model = docs.sparkSession.sparkContext.broadcast((names, logp))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logp = model.value
        for batch in batches:
            known = [UNKNOWN] * batch.num_rows
            score = [0.0] * batch.num_rows
            every: list[list[dict]] = [[] for _ in known]
            letters = batch.column("letters").to_pylist()
            if names:
                for first, stop, bucket, owner in _trigrams(batch.column("text")):
                    shares = mixture(bucket, owner - first, stop - first, logp)
                    best = shares.argmax(axis=1)
                    for row in range(first, stop):
                        if letters[row]:
                            found = shares[row - first]
                            at = int(best[row - first])
                            known[row] = names[at]
                            score[row] = min(1.0, float(found[at]))
                            every[row] = [{"lang": names[k], "share": float(found[k])} for k in np.flatnonzero(found).tolist()]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(known), pa.array(score), pa.array(every, kind)],
                names=["doc_id", "lang_pred", "score", "shares"],
            )

    text = F.col("text").cast("string")
    letters = F.coalesce(text.rlike(LETTER), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), letters.alias("letters"))
    return rows.mapInArrow(
        lean(run), "doc_id long, lang_pred string, score double, shares array<struct<lang: string, share: double>>"
    )


def with_background(logp: np.ndarray) -> np.ndarray:
    """The log-probabilities and one more component, last, under which all buckets are equally likely."""
    return np.vstack([logp, np.full((1, logp.shape[1]), -np.log(logp.shape[1]))])


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose main language is known: not ``und``, and with a share of at least ``least``.

    A background is a component of the mixture beside the languages: trigrams that no language has seen fall to it, and
    a text goes if its share is above that of every language.  Columns and texts stay as they are; the model is learned
    from the labelled rows of ``docs`` that are not held out.  If no language can be learned, every text with a letter
    stays.
    """
    names, logp = train(docs.filter(~held_out(F.col("doc_id"))))
    lettered = docs.filter(F.col("text").cast("string").rlike(LETTER))
    if not names:
        return lettered
    model = docs.sparkSession.sparkContext.broadcast(with_background(logp))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.zeros(batch.num_rows, bool)
            for first, stop, bucket, owner in _trigrams(batch.column("text").cast(pa.string())):
                shares = mixture(bucket, owner - first, stop - first, model.value)
                most = shares[:, :-1].max(axis=1)
                known[first:stop] = (most >= least) & (most >= shares[:, -1])
            yield batch.filter(pa.array(known))

    return lettered.mapInArrow(lean(run), docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """``predict`` on all of ``docs`` (doc_id, text, lang) with what its labelled rows teach that are not held out,
    and the column ``held_out``.  An empty table gives an empty table; other columns are ignored."""
    names, logp = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, names, logp).withColumn("held_out", held_out(F.col("doc_id")))
