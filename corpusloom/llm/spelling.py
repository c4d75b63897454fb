"""Spelling variants by pivotal grams (Deng, Li and Feng, 2014).

Two words are near if one inserted, deleted or replaced code point turns one into the other.  All two-letter grams are
ordered by how many words have them, rarest first.  One edit breaks at most two grams, so a word's *prefix* is its three
rarest grams (with all places of the third one's gram).  Of the prefix, dynamic programming over the places chooses two
*pivots*: disjoint grams of least total frequency.  One edit breaks at most one of two disjoint grams.  So of two near
words, the one whose prefix ends no later in the order has a pivot that the other has in its prefix.

The edit lies behind the first pivot, then that pivot's place and all before it are the same, or before the second one,
then its place from the end and all behind it are the same.  What lies on the edit's side of the pivot is halved, and one
of the halves is the same too.  Pivots meet the prefixes of other words in one equality join on (place, unchanged part,
length), and what meets is verified by its edit distance.

Words are letters of one alphabet (a-z and U+00C0 to U+00FF), so there are at most 90 * 90 grams, whatever the number of
words: their counts are the only thing that goes through the driver.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.lines import LOWER, UPPER
from corpusloom.llm.work import store

RUN = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH = 7  # a word needs three grams, and its prefix two disjoint ones: four code points at least
LEAST_COUNT = 2
RATIO = 10
LETTERS = 26 + 64
PREFIX = 3


def words(docs: DataFrame, slip: int = 31, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the runs of letters of all texts, A-Z in lower case.

    With ``slip``, a run loses the code point ``h % length`` if ``slip`` divides h, the crc32 of ``<doc_id>:<run>``.
    Null texts have no runs; a null doc_id counts as an empty string there.
    """
    run = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"({RUN}{{{least_length},}})"), F.lit(1))
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_doc"),
        F.explode(run).alias("_run"),
    ).select("_doc", F.translate("_run", UPPER, LOWER).alias("_run"))
    word = F.col("_run")
    if slip:
        runs = runs.withColumn("_h", F.crc32(F.concat_ws(":", "_doc", "_run").cast("binary")))
        at = F.col("_h") % F.char_length("_run")
        cut = F.concat(F.substring(word, F.lit(1), at.cast("int")), F.substring(word, (at + 2).cast("int"), F.char_length("_run")))
        word = F.when(F.col("_h") % slip == 0, cut).otherwise(word)
    counted = runs.select(word.alias("word")).filter(F.char_length("word") >= least_length)
    return counted.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _letter(char: Column) -> Column:
    code = F.ascii(char)
    return F.when(code < 128, code - 97).otherwise(code - (0xC0 - 26))


def _gram_codes(word: Column) -> Column:
    """The code of the gram at each place of a word."""
    return F.transform(
        F.sequence(F.lit(1), F.char_length(word) - 1),
        lambda i: _letter(F.substring(word, i, F.lit(1))) * LETTERS + _letter(F.substring(word, i + 1, F.lit(1))),
    )


def _pivots(prefix: Column) -> Column:
    """The places of two disjoint grams of least total frequency; ties go to the smaller places.

    Over the prefix in order of places the state is: the cheapest gram before the last one, the last one, and the
    cheapest pair.  A gram may pair with the last one only if it is not its neighbour, and with all before that always.
    """
    one = "struct<f:bigint,g:int,p:int>"
    start = F.from_json(F.lit("{}"), f"struct<far:{one},near:{one},pair:struct<f:bigint,a:{one},b:{one}>>")

    def step(state: Column, x: Column) -> Column:
        near, far = state["near"], state["far"]
        before = F.least(far, F.when(near["p"] <= x["p"] - 2, near))
        pair = F.when(before.isNotNull(), F.struct((before["f"] + x["f"]).alias("f"), before.alias("a"), x.alias("b")))
        return F.struct(F.least(far, near).alias("far"), x.alias("near"), F.least(state["pair"], pair).alias("pair"))

    by_place = F.array_sort(prefix, lambda x, y: x["p"] - y["p"])
    return F.aggregate(by_place, start, step, lambda s: F.array(s["pair"]["a"], s["pair"]["b"]))


def _behind(word: Column, place: Column, length: Column) -> list[Column]:
    """Keys for an edit behind the gram at a place (from 0) of a word of ``length``: in the front or the back half."""
    start = place + 2
    back = F.floor((length - start) / 2).cast("int")
    head = F.substring(word, F.lit(1), start)
    fits = length - start >= 2
    return [
        F.when(fits, F.xxhash64(F.lit(0), length, start, head, F.right(word, back))),
        F.when(fits, F.xxhash64(F.lit(1), length, start, F.substring(word, F.lit(1), length - back))),
    ]


def _before(word: Column, rest: Column, length: Column) -> list[Column]:
    """Keys for an edit before the gram with which the last ``rest`` code points begin: in the back or the front half."""
    front = F.floor((length - rest) / 2).cast("int")
    fits = length - rest >= 2
    return [
        F.when(fits, F.xxhash64(F.lit(2), length, rest, F.right(word, rest), F.substring(word, F.lit(1), front))),
        F.when(fits, F.xxhash64(F.lit(3), length, rest, F.right(word, length - front))),
    ]


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of all near words of ``vocabulary`` (word, n), both ways round.

    Words must be distinct and have at least four code points, all of the alphabet above.
    """
    coded = vocabulary.select("word", "n", _gram_codes(F.col("word")).alias("grams"))
    counts = coded.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("f")).collect()
    by_code = [0] * (LETTERS * LETTERS)
    for row in counts:
        by_code[row["g"]] = row["f"]
    frequency = F.from_json(F.lit(json.dumps(by_code)), "array<bigint>")
    placed = F.transform(
        "grams", lambda g, i: F.struct(F.get(frequency, g).alias("f"), g.cast("int").alias("g"), i.cast("int").alias("p"))
    )
    ordered = coded.select("word", "n", F.array_sort(placed).alias("_o"))
    last = F.get("_o", F.lit(PREFIX - 1))
    within = F.filter("_o", lambda x: (x["f"] < last["f"]) | ((x["f"] == last["f"]) & (x["g"] <= last["g"])))
    prefixes = store(ordered.select("word", "n", F.char_length("word").alias("length"), within.alias("prefix")), "gram-prefixes")
    word, length = F.col("word"), F.col("length")

    def listed(x: Column) -> Column:
        """The keys of a gram for a word of this length, one less or one more."""
        keys = [k for change in (-1, 0, 1) for k in (*_behind(word, x["p"], length + change), *_before(word, length - x["p"], length + change))]
        return F.array_compact(F.array(*keys))

    pivots = prefixes.select(word.alias("other"), F.col("n").alias("other_n"), "length", _pivots(F.col("prefix")).alias("_p"))
    first, second = F.get("_p", F.lit(0)), F.get("_p", F.lit(1))
    asked = F.array(*_behind(F.col("other"), first["p"], length), *_before(F.col("other"), length - second["p"], length))
    probes = pivots.select("other", "other_n", F.explode(asked).alias("key"))
    index = prefixes.select("word", "n", F.explode(F.flatten(F.transform("prefix", listed))).alias("key"))
    met = probes.join(index, "key").filter((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1))
    pairs = met.select("word", "n", "other", "other_n")
    turned = met.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return pairs.unionByName(turned).repartition("word").dropDuplicates(["word", "other"])


def variants(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``vocabulary`` (word, n).

    A word's form is its near word of largest n, ties going to the smaller word, if that n is ``ratio`` times the
    word's n at least.  The root is the last word that forms lead to, the word itself without a form.  An empty
    vocabulary gives an empty table.
    """
    vocabulary = store(vocabulary.select("word", "n"), "words")
    best = near_words(vocabulary).groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("_best"),
    )
    enough = -F.col("_best.less") >= ratio * F.col("n")
    best = best.select(
        "word",
        "n_near",
        F.when(enough, F.col("_best.other")).alias("form"),
        F.when(enough, -F.col("_best.less")).alias("form_n"),
    )
    best = store(best, "word-forms")
    roots = _roots(best.filter("form is not null").select("word", "form"), vocabulary, ratio)
    return (
        vocabulary.join(best, "word", "left")
        .join(roots, "word", "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            "form_n",
        )
    )


def _roots(forms: DataFrame, vocabulary: DataFrame, ratio: int) -> DataFrame:
    """(word, root) by pointer doubling; n grows by ``ratio`` with each form, so the steps follow from the largest n."""
    most = vocabulary.agg(F.max("n").alias("n")).first()["n"] or 1
    longest = max(1, math.ceil(math.log(max(most, 2), max(ratio, 2))))
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(longest)))):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = store(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "word-roots")
    return now


def spelling_variants(docs: DataFrame, slip: int = 31) -> DataFrame:
    """``variants`` of the words of all texts.  Repeated rows count as often as they are there."""
    return variants(words(docs, slip))
