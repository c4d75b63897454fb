"""A training corpus in steps: each stage takes a table of documents and gives one, the last one gives packed pieces.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  Every stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import langid, lines, minhash, mixing
from corpusloom.llm import packing as packing_operator
from corpusloom.llm.work import documents, store

TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, without a language that has 30 percent of them, or of no learned language go."""
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; a document stays, with what is left of its text."""
    kept = lines.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more) stays, the one with the smallest doc_id."""
    gone = minhash.near_duplicates(docs, percent=80).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in training order, each as often as its source's target asks for."""
    return mixing.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 token ids with their sequence and place, sequences in the order of the mix."""
    cut = packing_operator.pieces(packing_operator.in_file_order(docs), public_tokenizers.path(TOKENIZER), order="_position")
    return packing_operator.pack_in_order(cut.withColumn("ids_crc32", F.crc32("ids")))


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: Language models, hash order and packing have no SQL twin; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
