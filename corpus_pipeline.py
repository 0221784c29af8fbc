"""From raw documents to packed training sequences: quality, language, near copies, packing.

``STAGES`` are (name, function) pairs.  A function takes (spark, docs, sf_dir) and returns the rows
it keeps; each result is written as Parquet and reread as the next stage's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenlake.llm import hyperminhash, language_id, packing, quality
from wardenlake.llm.common import fold, through_table

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels that are not held out.

    Null and empty texts get the score of a text without features and are kept or not by it; very
    long texts count whole.  Rows that repeat are all kept or all dropped, rows without an id are judged by their text.  Other
    columns are left out.  Without labels every document is kept; an empty table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, fold(F.col("doc_id"), 5) != 0)
    return quality.score(docs.select(DOCUMENT), model).where("predicted = 1").select(DOCUMENT)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter, or that its model can't shorten below eight bits a byte, go.

    Null and empty texts have no letter.  Very long texts count whole, rows that repeat or have no id
    are judged by their text, ties between languages don't matter here.  Where no language can be learned, no document is identified and all go; an
    empty table gives no rows.
    """
    model = language_id.train(docs, fold(F.col("doc_id"), 3) != 1)
    return language_id.identify(docs.select(DOCUMENT), model).where("lang_pred <> 'und' and bits < flat_bits").select(DOCUMENT)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 and more), that with the smallest id.

    A document is an id with a text: each text of a repeated id is judged on its own, and of rows that
    repeat both one stays.  Rows without an id are told apart by their texts and rank behind all ids.
    Null and empty texts are no copies of anything.  An empty table gives no rows.
    """
    id_ = F.coalesce("doc_id", F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2))
    named = docs.select(id_.alias("id"), hyperminhash.mark_of(id_, "text").alias("mark"), *DOCUMENT)
    first = hyperminhash.near_duplicates(named, key="id").where("first").select("id", "mark").distinct()
    return named.dropDuplicates(["id", "mark"]).join(first, ["id", "mark"], "left_semi").select(DOCUMENT)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of every document and their places in sequences of at most 1024 tokens.

    Null and empty texts are one piece with the end id only, long ones as many as they need; rows that
    repeat or have no id are packed each on their own.  An empty table gives no rows.
    """
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", keep_quality),
    ("language id", keep_identified),
    ("MinHash near-dedup", keep_distinct),
    ("best-fit packing", into_sequences),
]

ORACLE_SQL = None  # the classifiers can't be said in SQL; tests/llm compares run() with plain-Python versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result goes through a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = through_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
