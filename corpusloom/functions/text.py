"""Text columns: analysis into terms, style removal, and text predicates."""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.binding import let

# Stop words, English then Chinese.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then "
    "there these they this to was will with we can from which you have all one has "
    "的 了 和 是 就 都 而 及 与 于 着 或 我 在 你 一个 没有 是否 药品 名称"
).split()

CJK = "一-龥"
ROWS_OUT = 20_000  # terms that a task holds as Python values before they leave as one Arrow batch

TEXT_BYTES = 8_000_000  # of texts that a task counts at once, some 100 MB of its memory
BLOCK_DOCS = 1000  # postings in a row, at most

# Letters and digits of Latin, Greek and Cyrillic; a run of them is one term.
WORD = "0-9a-zA-ZÀ-ÖØ-öø-ɏͰ-ϿЀ-ӿ"


def token_pattern(dictionary: Iterable[str] = ()) -> str:
    """Word runs, then dictionary words (longest first), then single CJK characters.

    A pattern suits a handful of words; ``operators.search.dictionary_terms`` takes them as a table of any size.
    """
    words = sorted({w.lower() for w in dictionary if w}, key=lambda w: (-len(w), w))
    by_first: dict[str, list[str]] = defaultdict(list)
    for word in words:
        by_first[word[0]].append(re.escape(word[1:]))
    longest = [f"{re.escape(first)}(?:{'|'.join(rest)})" for first, rest in by_first.items()]
    return "|".join([*longest, f"[{WORD}]+", f"[{CJK}]"])


def tokens(text: Column, dictionary: Iterable[str] = ()) -> Column:
    """All terms in order, stop words included."""
    return F.regexp_extract_all(F.lower(text), F.lit(token_pattern(dictionary)), F.lit(0))


def terms(text: Column, stop_words: Iterable[str] = STOP_WORDS, dictionary: Iterable[str] = ()) -> Column:
    """Terms in order with stop words dropped: the one analyzer for index and query."""
    stop = list(stop_words)
    found = tokens(text, dictionary)
    return F.filter(found, lambda term: ~term.isin(stop)) if stop else found


def terms_of(text: str, stop_words: Iterable[str] = STOP_WORDS, dictionary: Iterable[str] = ()) -> list[str]:
    """The same analyzer for one query text held by the caller."""
    stop = set(stop_words)
    return [t for t in re.findall(token_pattern(dictionary), text.lower()) if t not in stop]


def positioned_terms(text: Column, stop_words: Iterable[str] = STOP_WORDS, dictionary: Iterable[str] = ()) -> Column:
    """``array<struct<term, pos, start, end>>``; positions count stop words, offsets are characters.

    Spark has no expression for the offsets of all matches, hence the Arrow UDF.
    """
    pattern, stop = token_pattern(dictionary), frozenset(stop_words)

    @F.pandas_udf("array<struct<term:string,pos:int,start:int,end:int>>")
    def locate(batch: pd.Series) -> pd.Series:
        find = re.compile(pattern).finditer
        return batch.map(
            lambda t: [
                {"term": m.group(), "pos": i, "start": m.start(), "end": m.end()}
                for i, m in enumerate(find((t or "").lower()))
                if m.group() not in stop
            ]
        )

    return locate(text)


def _located(
    fields: Sequence[str], stop_words: Iterable[str], dictionary: Iterable[str], batches: Iterable[pa.RecordBatch]
) -> Iterator[tuple[pa.RecordBatch, int, str, Iterator[tuple[str, int, int, int]]]]:
    """Batch, row, field and a lazy (term, pos, start, end) of every text; one text at a time is a Python value."""
    find, stop = re.compile(token_pattern(dictionary)).finditer, frozenset(stop_words)
    for batch in batches:
        for row in range(batch.num_rows):
            for field in fields:
                text = (batch.column(field)[row].as_py() or "").lower()
                yield batch, row, field, ((m.group(), i, *m.span()) for i, m in enumerate(find(text)) if m.group() not in stop)


def located_terms(fields: Sequence[str], stop_words: Iterable[str] = STOP_WORDS, dictionary: Iterable[str] = ()) -> Callable:
    """For ``mapInArrow`` of (_id, *fields): rows (_id, field, term, pos, start, end), as ``positioned_terms`` has them.

    At most ``ROWS_OUT`` rows are held, however many texts a batch has and however long they are.
    """
    fields, stop_words, dictionary = tuple(fields), tuple(stop_words), tuple(dictionary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column("_id").take(pa.array(rows, pa.int64()))
            columns = [pa.array(values, kind) for values, kind in zip(zip(*found), (pa.string(), pa.int32(), pa.int32(), pa.int32()))]
            return pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), *columns], names=["_id", "field", "term", "pos", "start", "end"])

        rows, names, found, last = [], [], [], None
        for batch, row, field, places in _located(fields, stop_words, dictionary, batches):
            if batch is not last and found:
                yield made(last)
                rows, names, found = [], [], []
            last = batch
            for place in places:
                rows.append(row)
                names.append(field)
                found.append(place)
                if len(found) >= ROWS_OUT:
                    yield made(batch)
                    rows, names, found = [], [], []
        if found:
            yield made(last)

    return run


def grouped_terms(fields: Sequence[str], stop_words: Iterable[str] = STOP_WORDS, dictionary: Iterable[str] = ()) -> Callable:
    """The same with one row per text and term: (_id, field, term, places<pos, start, end>), places in order.

    Held are the places of one text and at most ``ROWS_OUT`` more.
    """
    fields, stop_words, dictionary = tuple(fields), tuple(stop_words), tuple(dictionary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column("_id").take(pa.array(rows, pa.int64()))
            parts = [pa.array(values, pa.int32()) for values in zip(*places)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, names=["pos", "start", "end"]))
            columns = [ids, pa.array(names, pa.string()), pa.array(words, pa.string()), lists]
            return pa.RecordBatch.from_arrays(columns, names=["_id", "field", "term", "places"])

        rows, names, words, places, ends, last = [], [], [], [], [0], None
        for batch, row, field, found in _located(fields, stop_words, dictionary, batches):
            if words and (batch is not last or len(places) >= ROWS_OUT):
                yield made(last)
                rows, names, words, places, ends = [], [], [], [], [0]
            last = batch
            by_term: dict[str, list[tuple[int, int, int]]] = {}
            for term, *place in found:
                by_term.setdefault(term, []).append(place)
            for term, at in by_term.items():
                rows.append(row)
                names.append(field)
                words.append(term)
                places.extend(at)
                ends.append(len(places))
        if words:
            yield made(last)

    return run


def _text_sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each row's text, or list of texts."""
    if not pa.types.is_list(column.type):
        return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    till = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    sizes = pc.fill_null(pc.binary_length(column.flatten()), 0).to_numpy(zero_copy_only=False)
    return np.diff(np.append(0, np.cumsum(sizes, dtype=np.int64))[till], prepend=0)


def text_pieces(batches: Iterable[pa.RecordBatch], most: int | None = None) -> Iterator[pa.Table]:
    """Rows of about ``TEXT_BYTES`` of text, ``most`` of them, or one row with more."""
    held, size, rows = [], 0, 0
    for batch in batches:
        sizes = sum(_text_sizes(c) for c in batch.columns[1:])
        at = 0
        while at < batch.num_rows:
            fits = int(np.searchsorted(np.cumsum(sizes[at:]), TEXT_BYTES - size, side="right"))
            n = min(max(fits, 0 if held else 1), batch.num_rows - at, batch.num_rows if most is None else most - rows)
            if n:
                held.append(batch.slice(at, n))
                size += int(sizes[at : at + n].sum())
                rows += n
                at += n
            if at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def term_blocks(fields: Sequence[str], stop_words: Iterable[str] = STOP_WORDS, dictionary: Iterable[str] = ()) -> Callable:
    """For ``mapInArrow`` of (_id, lower-case texts of the fields, none null): postings in rows by term.

    Rows (field, term, ids, tfs, lengths, n, total): up to ``BLOCK_DOCS`` documents that have the term, n of them, in
    arrays of one order.  A row without a term has the number of texts in n and of their terms in total.
    """
    fields, dictionary = tuple(fields), tuple(dictionary)
    left_out = pa.array(["", *stop_words], pa.string())
    find = re.compile(token_pattern(dictionary)).findall

    def cut(texts: pa.Array) -> pa.Array:
        if dictionary:
            return pa.array([find(text) for text in texts.to_pylist()], pa.list_(pa.string()))
        if pc.any(pc.match_substring_regex(texts, f"[{CJK}]")).as_py():
            texts = pc.replace_substring_regex(texts, f"([{CJK}])", r" \1 ")
        return pc.split_pattern_regex(texts, f"[^{WORD}{CJK}]+")

    def counted(ids: pa.Array, field: str, texts: pa.Array) -> pa.RecordBatch:
        found, n = cut(texts), len(texts)
        coded = found.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        row = np.repeat(np.arange(n), found.value_lengths().to_numpy())
        wanted = pc.invert(pc.is_in(coded.dictionary, left_out)).to_numpy(zero_copy_only=False)[code]
        code, row = code[wanted], row[wanted]
        length = np.bincount(row, minlength=n).astype(np.int32)
        pair, tf = np.unique(code.astype(np.int64) * n + row, return_counts=True)
        code, row = pair // n, pair % n
        first = np.flatnonzero(np.diff(code, prepend=-1))
        place = np.arange(len(code)) - np.repeat(first, np.diff(first, append=len(code)))
        begins = np.flatnonzero(place % BLOCK_DOCS == 0)
        ends = np.append(begins, len(code))
        sizes = np.diff(ends)
        ends = pa.array(ends.astype(np.int32))
        parts = ids.take(pa.array(row)), pa.array(tf.astype(np.int32)), pa.array(length[row])
        lists = [pa.ListArray.from_arrays(ends, part) for part in parts]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([field] * (len(begins) + 1), pa.string()),
                pa.concat_arrays([coded.dictionary.take(pa.array(code[begins])), pa.nulls(1, pa.string())]),
                *[pa.concat_arrays([part, pa.nulls(1, part.type)]) for part in lists],
                pa.array([*sizes.tolist(), n], pa.int64()),
                pa.concat_arrays([pa.nulls(len(begins), pa.int64()), pa.array([int(length.sum())], pa.int64())]),
            ],
            names=["field", "term", "ids", "tfs", "lengths", "n", "total"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_pieces(batches):
            piece = piece.combine_chunks()
            ids, *texts = (column.chunk(0) for column in piece.columns)
            for field, column in zip(fields, texts):
                yield counted(ids, field, column)

    return run


@cache
def _kinds() -> np.ndarray:
    """Per character below U+10000: 1 in a run that is one term, 2 if it is a term alone, else 0, as for all above."""
    kinds, every = np.zeros(0x10001, np.uint8), "".join(map(chr, range(0x10000)))
    for kind, letters in ((1, WORD), (2, CJK)):
        kinds[[m.start() for m in re.finditer(f"[{letters}]", every)]] = kind
    return kinds


def located(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Number of the text, position, start in characters, and the term itself of all terms of lower-case texts."""
    joined = "".join(f"{text}\n" for text in texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = _kinds()[np.minimum(points, 0x10000)]
    word, alone = kind == 1, kind == 2
    begins = np.flatnonzero(alone | (word & ~np.append(False, word[:-1])))
    ends = np.flatnonzero(alone | (word & ~np.append(word[1:], False))) + 1
    utf8 = np.frombuffer(joined.encode(), np.uint8)
    inside, sizes = kind > 0, ends - begins
    if len(utf8) > len(points):
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        till = np.append(0, np.cumsum(width, dtype=np.int64))
        inside, sizes = np.repeat(inside, width), till[ends] - till[begins]
    letters, offsets = utf8[inside], np.append(0, np.cumsum(sizes)).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(letters))
    bounds = np.append(0, np.cumsum([len(text) + 1 for text in texts], dtype=np.int64))
    first = np.searchsorted(begins, bounds)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    return text, np.arange(len(begins)) - first[text], begins - bounds[text], terms


def terms_at(text: Column, starts: Column) -> Column:
    """Terms of a text in order, dictionary words at the places ``array<struct<at, n>>``, from 0, where they start."""
    other = re.compile(f"[{WORD}]+|[{CJK}]")

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series, known: pd.Series) -> pd.Series:
        def terms_of_one(body: str, found) -> list[str]:
            size_at = {f["at"]: f["n"] for f in found} if found is not None else {}
            out, at = [], 0
            while at < len(body):
                size = size_at.get(at)
                if size is None:
                    match = other.match(body, at)
                    size = match.end() - at if match else 0
                if size:
                    out.append(body[at : at + size])
                at += size or 1
            return out

        return pd.Series([terms_of_one(t or "", f) for t, f in zip(texts, known)])

    return cut(text, starts)


_DICTIONARIES: dict[str, tuple] = {}  # one per worker


def _dictionary_at(path: str) -> tuple:
    """The automaton of a stored table (word, stop) and its stop words, loaded once per worker."""
    if path not in _DICTIONARIES:
        import ahocorasick
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))
        rows = pq.read_table(place, filesystem=system)
        automaton, stop = ahocorasick.Automaton(ahocorasick.STORE_INTS), set()
        for word, stops in zip(rows["word"].to_pylist(), rows["stop"].to_pylist()):
            if stops:
                stop.add(word)
            else:
                automaton.add_word(word, len(word))
        automaton.make_automaton()
        _DICTIONARIES.clear()
        _DICTIONARIES[path] = (automaton, stop)
    return _DICTIONARIES[path]


def terms_by_dictionary(text: Column, path: str) -> Column:
    """Terms of a lower-case text by the dictionary stored at ``path``: one pass of an automaton over the text.

    At every place the longest dictionary word counts, else a run of word characters, else a single CJK character.
    """
    other = re.compile(f"[{WORD}]+|[{CJK}]")

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        automaton, stop = _dictionary_at(path)

        def terms_of_one(body: str) -> list[str]:
            size_at: dict[int, int] = {}
            if len(automaton):
                for end, size in automaton.iter(body):
                    start = end - size + 1
                    if size > size_at.get(start, 0):
                        size_at[start] = size
            out, at = [], 0
            while at < len(body):
                size = size_at.get(at)
                if size is None:
                    match = other.match(body, at)
                    size = match.end() - at if match else 0
                if size and body[at : at + size] not in stop:
                    out.append(body[at : at + size])
                at += size or 1
            return out

        return texts.fillna("").map(terms_of_one)

    return cut(text)


def term_counts(found: Column) -> Column:
    """``array<struct<term, tf>>`` of an array of terms, made inside the row.

    Equal terms are neighbours after sorting: a run starts where a term differs
    from the one before, and ends where the next run starts.
    """

    def runs(ordered: Column) -> Column:
        starts = F.transform(ordered, lambda t, i: F.when((i == 0) | (F.get(ordered, i - 1) != t), i))

        def count(begin: Column) -> Column:
            end = F.concat(F.slice(begin, 2, F.size(begin)), F.array(F.size(ordered)))
            return F.zip_with(
                begin, end, lambda i, j: F.struct(F.get(ordered, i).alias("term"), (j - i).alias("tf"))
            )

        return let(F.filter(starts, lambda i: i.isNotNull()), count)

    # an empty array leaves one run without a term
    return F.filter(let(F.sort_array(found), runs), lambda run: run["term"].isNotNull())


def _replace(text: Column, *rules: tuple[str, str]) -> Column:
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return text


# Markdown marks and tags out, their text kept; an image leaves nothing.  Every rule is linear: a label has no bracket
# inside, a target only paired ones, and repeated groups are possessive, which the matcher runs without recursion.
_TARGET = r"\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)"
_LINK = rf"!?\[[^\[\]]*+\]{_TARGET}"
_STYLE = (
    (r"(?m)^[ \t]*+(?:```|~~~).*$", ""),
    (rf"!\[[^\[\]]*+\]{_TARGET}", ""),
    (rf"\[([^\[\]]*+)\]{_TARGET}", "$1"),
    (r"(?m)^[ \t]*+(?:[-*_][ \t]*+){3,}+$", ""),
    (r"(?m)^[ \t]{0,3}#{1,6}[ \t]++((?:[^ \t#\n]++|[ \t#]++(?=[^ \t#\n]))*+)[ \t#]*+$", "$1"),
    (r"(?m)^[ \t]*+>[ \t]?", ""),
    (r"(?m)^[ \t]*+(?:[-*+]|[0-9]++\.)[ \t]++", ""),
    (r"\*\*([^*\n]++)\*\*", "$1"),
    (r"__([^_\n]++)__", "$1"),
    (r"\*([^*\s][^*\n]*+)\*", "$1"),
    (r"\b_([^_\n]++)_\b", "$1"),
    (r"`([^`]*+)`", "$1"),
    (r"<[/!a-zA-Z][^<>]*+>", ""),
)


def remove_style(text: Column) -> Column:
    """Plain text of a Markdown text: labels of links stay, marks and tags go."""
    from corpusloom.functions.html import unescape

    return unescape(_replace(text, *_STYLE))


def remove_style_fully(text: Column) -> Column:
    """As ``remove_style``, but links and images go wholly and newline runs become one."""
    without_links = F.regexp_replace(text, _LINK, "")
    return F.regexp_replace(remove_style(without_links), r"\n+", "\n")


def map_lines(text: Column, change) -> Column:
    """Apply a column function to each line and join the lines again."""
    return F.array_join(F.transform(F.split(text, "\n"), change), "\n")


def _letters_only(text: Column) -> Column:
    # U+4E00-U+9FA5 lies inside \w only with Unicode classes, so it is named.
    return F.lower(F.regexp_replace(text, r"[^0-9A-Za-z_一-龥]+", ""))


def almost_same(left: Column, right: Column) -> Column:
    return _letters_only(left) == _letters_only(right)


def is_english(text: Column) -> Column:
    return text.rlike(r"^[a-zA-Z]+\z")


def is_question(text: Column) -> Column:
    return text.rlike(f"^[{CJK}]+\\?\\z")


def questions(title: Column, description: Column) -> Column:
    """The title and the description tokens that are questions, as one array."""
    parts = F.concat(F.array(F.coalesce(title, F.lit(""))), F.split(F.coalesce(description, F.lit("")), r"\s+"))
    return F.filter(parts, is_question)


def first_value(values: Column) -> Column:
    """First value that is not empty after trimming."""
    return F.try_element_at(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""), F.lit(1))
