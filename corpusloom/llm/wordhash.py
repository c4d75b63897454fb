"""Word and shingle hashes of Arrow text columns, vectorised over the bytes of many texts at once.

A word is a run of bytes other than space and ``\\x09-\\x0D``.  Its hash is a polynomial in fixed random byte values
modulo 2**64, passed through a bit mixer; with ``fold`` the letters A-Z have the values of a-z.  Texts are worked off in
blocks of bytes, cut between texts or, inside a text longer than a block, between words, so memory does not grow with
the longest text; a block grows only with a word that is longer than it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

Parts = Callable[[np.ndarray, np.ndarray], np.ndarray]
BLOCK = 1 << 18
WIDTH = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose bits all depend on all input bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(count: int, seed: int) -> np.ndarray:
    """``count`` fixed odd 64-bit values."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)
        return mix(steps * np.uint64(_BASE)) | np.uint64(1)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.ones(count, np.uint64)
    have = 1
    with np.errstate(over="ignore"):
        while have < count:
            more = min(have, count - have)
            out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
            have += more
    return out


_POWER = _powers(_BASE, BLOCK + 1)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), BLOCK + 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = constants(256, 1)
_FOLDED = _PLAIN.copy()
_FOLDED[65:91] = _PLAIN[97:123]
_PLACES = constants(WIDTH, 2)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the ends of its values; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def _block_words(
    data: np.ndarray, cuts: np.ndarray, table: np.ndarray, parts: Parts | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of one block; ``cuts``: positions at which a new text starts.

    ``parts`` cuts words further: from the bytes and the words' first bytes it tells at which bytes a part starts.
    """
    n = len(data)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = cuts[cuts < n]
    first[inner] = word[inner]
    if parts is not None:
        first |= word & parts(data, first)
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    power, inverse = (_POWER, _INVERSE) if n <= BLOCK else (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * power[:n], out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts]), starts, ends


def word_hashes(
    data: np.ndarray, ends: np.ndarray, fold: bool = True, parts: Parts | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: the first text's number, word counts per text, and hash, start and end of every word."""
    table = _FOLDED if fold else _PLAIN
    at, n = 0, len(ends) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, "right")) - 1)
        low, high = int(ends[at]), int(ends[stop])
        if high - low <= BLOCK:
            hashes, starts, stops = _block_words(data[low:high], ends[at:stop] - low, table, parts)
            counts = np.diff(np.searchsorted(starts, ends[at : stop + 1] - low))
            yield at, counts, hashes, starts + low, stops + low
        else:
            found = [_block_words(data[a:b], np.zeros(0, np.int64), table, parts) + (a,) for a, b in _pieces(data, low, high)]
            hashes = np.concatenate([f[0] for f in found])
            yield (
                at,
                np.array([len(hashes)]),
                hashes,
                np.concatenate([f[1] + f[3] for f in found]),
                np.concatenate([f[2] + f[3] for f in found]),
            )
        at = stop


def _pieces(data: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Byte ranges that end after white space, of at most a block; a longer word's range goes on to the word's end."""
    while low < high:
        stop = min(low + BLOCK, high)
        if stop < high:
            spaces = np.flatnonzero(_SPACE[data[low:stop]])
            if len(spaces):
                stop = low + int(spaces[-1]) + 1
            else:
                while stop < high and not _SPACE[data[stop]]:
                    ahead = _SPACE[data[stop : min(stop + BLOCK, high)]]
                    stop += int(ahead.argmax()) if ahead.any() else len(ahead)
        yield low, stop
        low = stop


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's ``width``-word shingles, words in lower case.

    A text with fewer words has one shingle, its whole sequence; a text without words has none.
    """
    data, ends = text_bytes(column)
    places = _PLACES if width == WIDTH else constants(width, 2)
    for _, counts, hashes, _, _ in word_hashes(data, ends):
        with np.errstate(over="ignore"):
            if len(hashes) >= width:
                rolled = sum(hashes[k : len(hashes) - width + 1 + k] * places[k] for k in range(width))
                rolled = mix(rolled)
            at = 0
            for count in counts.tolist():
                if count >= width:
                    yield np.unique(rolled[at : at + count - width + 1])
                elif count:
                    short = (hashes[at : at + count] * places[:count]).sum(dtype=np.uint64)
                    yield mix(np.array([short ^ np.uint64(count)], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)
                at += count
