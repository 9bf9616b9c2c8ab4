"""A corpus pipeline of five stages, each calling one operator of ``ledgerlens.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of documents.

Defined cases: empty tables pass through every stage; null texts count as empty; rows of equal
doc_id and text are one document after the second stage; extra columns of documents are kept
up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, classifier, minhash, mixing, substrings
from ledgerlens.llm.catalog import held_out
from ledgerlens.llm.common import read_table, stored

MIN_QUALITY = 0.3
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
WINDOW_WORDS = 20
SOURCE_WEIGHTS, MAX_REPEATS = (5, 2, 1), 3
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled documents, does not reject."""
    labels = read_table(spark, sf_dir, "labels").filter(~held_out())
    trees = classifier.fit(docs, labels)
    scored = classifier.score(docs, trees, docs.columns)
    return scored.filter(F.col("quality_score") >= MIN_QUALITY).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.drop_near_duplicates(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that start earlier in the corpus; n_chars follows the text."""
    cut = substrings.dedup(docs, WINDOW_WORDS)
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, n_chars).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mixed to their sources' target weights, in shuffled shards."""
    return mixing.mixed_documents(docs, SOURCE_WEIGHTS, MAX_REPEATS)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), TOKENIZER), TOKENIZER)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("bpe", bpe_encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


# fitted trees and byte-pair merges have no SQL form
ORACLE_SQL = None
