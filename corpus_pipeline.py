"""A training-data pipeline over ``documents``: each stage is one operator, and works on all its predecessor kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as
the next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import bpe, decontaminate, near, substring, toxicity
from fieldloom.shipping import ship
from fieldloom.staging import release, stage

#: Words of a test item below which it drops no document: chance repeats such items.
LEAST_WORDS = 5


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Null and empty texts have the score of the model's bias alone and stay unless that rejects. Repeated rows and null
    ids share the fate of their text. An empty table stays empty; without usable labels nothing goes.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    Near are fingerprints within 4 bits and five-word shingle sets of a Jaccard similarity of 0.8 or more. Null ids
    come after all others; of rows of one id the one with the least hash of its text stays, of repeated rows one.
    Null and empty texts, and those of white space, are one group. An empty table stays empty.
    """
    ship(spark)
    return near.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur more than once are cut out of every text; all documents stay.

    Null texts stay null, texts of fewer than 35 words as they are; repeated rows repeat each other whole and become
    empty. ``n_chars``, where there is one, is counted anew. An empty table stays empty.
    """
    ship(spark)
    out = substring.dedup_texts(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item of LEAST_WORDS words or more go; shorter ones are no evidence for dropping a document.

    The shortest item of the given tables has 15 words, so none is left out there.
    Null and empty texts hold none and stay. Repeated rows and null ids stay or go as they are. Empty tables: all stay.
    """
    ship(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_words=LEAST_WORDS)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text that is left; null texts count as empty, repeated rows each give a row."""
    ship(spark)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(docs, bpe.ByteBPE(ranks, public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", bpe_round_trip),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``; between stages the documents are staged as Parquet, one copy at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        before, docs = docs, stage(step(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained model and a hash that DuckDB lacks decide what stays, so there is no SQL for the whole.
ORACLE_SQL = None
