"""Document fingerprints by consistent weighted sampling (Ioffe, 2010), in Spark's own expressions.

The terms of a text are its words, a term's weight is how often it occurs.  For sample k a term with weight w draws
``r`` and ``c`` from Gamma(2, 1) and ``b`` uniformly, all from one hash of (term, k), and gets

    step = floor(ln w / r + b),   ln a = ln c - r (step - b + 1);

the term with the least ``ln a`` is the sample, and (term, step) its value.  Two texts agree in a sample with a probability
equal to their generalised Jaccard similarity, sum of the smaller weights over sum of the larger ones.

Each (value, identity) is one long, the value in the upper bits, so that a sample is a plain ``min`` that folds row by
row.  A row holds a term's weights in two texts, which share the draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ranking import bucket_of

SAMPLES = 32
SEPARATORS = r"[\x20\x09-\x0D]+"
DRAW_BITS, SHIFT_BITS = 13, 12  # of a 64-bit hash: four draws for the gammas and one shift
IDENTITY_BITS = 28
IDENTITY_STEP = 155371729  # an odd factor, spreads the steps of one term over the identities
_IDENTITY = (1 << IDENTITY_BITS) - 1
_LOWEST = 60.0  # ln a lies within (-60, 4) for weights up to e^20
_SCALE = 2.0**29


def _draws(term: Column, sample: int) -> tuple[Column, Column, Column]:
    """r, ln c, b of a term's hash."""
    h = F.xxhash64(term, F.lit(sample))

    def uniform(shift: int, bits: int) -> Column:
        part = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1))
        return (part.cast("double") + 0.5) * F.lit(2.0**-bits)

    u = [uniform(i * DRAW_BITS, DRAW_BITS) for i in range(4)]
    return -F.log(u[0] * u[1]), F.log(-F.log(u[2] * u[3])), uniform(4 * DRAW_BITS, SHIFT_BITS)


def _coded(draws: tuple[Column, Column, Column], log_weight: Column, identity: Column) -> Column:
    r, log_c, b = draws
    step = F.floor(log_weight / r + b)
    value = ((log_c - r * (step - b + 1) + _LOWEST) * _SCALE).cast("long")
    return F.shiftleft(value, IDENTITY_BITS).bitwiseOR((identity + step * IDENTITY_STEP).bitwiseAND(F.lit(_IDENTITY)))


def signatures(weights: DataFrame, keys: list[str], columns: list[str], samples: int = SAMPLES) -> DataFrame:
    """One row per ``keys`` with an array of ``samples`` identities per weight column.

    ``weights`` has keys, ``term`` (long) and the weight columns (long); a weight of 0 says that the term is absent.
    A text without terms has -1 everywhere.
    """
    logs = weights.select(
        *keys,
        "term",
        F.shiftrightunsigned("term", 64 - IDENTITY_BITS).alias("_identity"),
        *[F.when(F.col(c) > 0, F.log(F.col(c).cast("double"))).alias(c) for c in columns],
    )
    least = []
    for k in range(samples):
        draws = _draws(F.col("term"), k)
        least += [F.min(_coded(draws, F.col(c), F.col("_identity"))).alias(f"{c}_{k}") for c in columns]
    found = logs.groupBy(*keys).agg(*least)
    absent = F.lit(-1).cast("long")
    one = lambda c, k: F.coalesce(F.col(f"{c}_{k}").bitwiseAND(F.lit(_IDENTITY)), absent)
    return found.select(*keys, *[F.array(*[one(c, k) for k in range(samples)]).alias(c) for c in columns])


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two signatures."""
    equal = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(equal, F.lit(0), lambda s, x: s + x) / F.size(a)


def fingerprint(signature: Column) -> Column:
    """The signature as a string, seven hexadecimal digits per sample; equal signatures have equal strings."""
    digits = F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(_IDENTITY)))), 7, "0"))
    return F.array_join(digits, "")


def with_next_text(docs: DataFrame, ranges: int) -> DataFrame:
    """(range, place, extra, _order, text, next_text): documents by descending doc_id, each with the next one's text,
    the last one with the first one's.

    Documents are cut into ranges of the id; the first document of a range is in the range before it once more, as an
    ``extra`` row at the end.  Equal ids are ordered by a hash of their texts; a null id comes last, and the least
    long counts as null.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the id is carried as its order alone, so that all that is derived from the ordered rows reads one exchange
    rows = docs.select(order.alias("_order"), text.alias("text"))
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = docs.agg(F.percentile_approx(order, shares, 100 * len(shares)).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts))
    if cuts:
        points = F.from_json(F.lit(str(cuts)), "array<bigint>")
        rows = rows.withColumn("_range", bucket_of(F.col("_order"), points, 2 * len(cuts)))
    else:
        rows = rows.withColumn("_range", F.lit(0))
    # one row per range
    heads = sorted((r["_range"], r["head"]) for r in rows.groupBy("_range").agg(F.max("_order").alias("head")).collect())
    used = [r for r, _ in heads]
    head_of = dict(heads)
    # a head stands at the end of the next higher range, the highest range's head at the end of the lowest
    target = {r: used[(i + 1) % len(used)] for i, r in enumerate(used)}
    top = (used[-1] if used else 0) + 1
    head_list = F.from_json(F.lit(str([head_of.get(r, 0) for r in range(top)])), "array<bigint>")
    target_list = F.from_json(F.lit(str([target.get(r, 0) for r in range(top)])), "array<int>")
    is_head = F.get(head_list, F.col("_range")) == F.col("_order")
    places = F.when(
        is_head,
        F.array(
            F.struct(F.col("_range").alias("range"), F.lit(False).alias("extra")),
            F.struct(F.get(target_list, F.col("_range")).alias("range"), F.lit(True).alias("extra")),
        ),
    ).otherwise(F.array(F.struct(F.col("_range").alias("range"), F.lit(False).alias("extra"))))
    placed = rows.select("_order", "text", F.inline(places))
    by = Window.partitionBy("range").orderBy("extra", F.desc("_order"), F.xxhash64("text"))
    return placed.select(
        "range",
        F.row_number().over(by).alias("place"),
        "extra",
        "_order",
        "text",
        F.lead("text").over(by).alias("next_text"),
    )


def edited(text: Column, next_text: Column) -> Column:
    """The last third of the code points (rounded down) replaced by as many first ones of the next text."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - third), F.substr(next_text, F.lit(1), third))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.

    A null text is empty.  Texts without words have one common fingerprint and likeness 1 to each other.  A table of one
    document is its own next.  Rows that repeat an id are documents of their own; an empty table gives an empty table.
    """
    ranges = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = with_next_text(docs, ranges).withColumn("edited", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    doc_id = F.when(F.col("_order") != -(2**63), F.col("_order")).alias("doc_id")
    facts = ordered.filter("not extra").select(
        "range", "place", doc_id, F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")
    )
    versions = F.array(
        F.struct(F.lit(0).alias("version"), F.col("text").alias("body")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("body"))
    )
    words = ordered.select("range", "place", F.inline(versions)).select(
        "range", "place", "version", F.explode(F.split("body", SEPARATORS)).alias("word")
    )
    real = F.col("word") != ""
    weights = (
        words.select("range", "place", F.xxhash64("word").alias("term"), *[
            F.when(real & (F.col("version") == v), F.lit(1)).otherwise(F.lit(0)).alias(c) for v, c in enumerate(("own", "other"))
        ])
        .groupBy("range", "place", "term")
        .agg(F.sum("own").alias("own"), F.sum("other").alias("other"))
    )
    signed = signatures(weights, ["range", "place"], ["own", "other"], samples)
    after = signed.withColumn("next", F.lead("own").over(Window.partitionBy("range").orderBy("place")))
    return facts.join(after, ["range", "place"]).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
