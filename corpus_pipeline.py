"""A corpus pipeline over the documents table: each stage is a (name, function) pair, (spark, docs, sf_dir) to a DataFrame.

All stages but the last return the columns of documents; the last returns the encoded corpus.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyspark.llm import bpe, decontam, minhash, substring_dedup, toxicity
from tidyspark.llm.common import cut, owned, release, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, rejects go. Null texts and repeated rows are judged like any."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def alone(stage):
    """stage, with the scratch tables of the stage before deleted: what that returned has been written and is read again as docs."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, "pipeline")
        with owned("pipeline"):
            return stage(spark, docs, sf_dir)

    return run


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: five-word shingles, similarity 0.8.

    The one with the smallest doc_id of a component stays, ties and repeated rows with it; null ids and texts without words stay.
    """
    return minhash.dedup(docs, width=5, percent=80)


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of repeated spans go, all but the first by doc_id and place; documents that lose all their text go with them. Null texts and repeated rows stay."""
    return substring_dedup.dedup(docs, ends=True).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go. Null texts and ids hold none; rows that share a doc_id go or stay together."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    (name, alone(stage)) for name, stage in
    (("toxicity", drop_toxic), ("minhash_dedup", drop_near_duplicates), ("substring_dedup", drop_repeated_spans), ("decontamination", drop_contaminated), ("bpe", encode))
]
#: Classifier, hashed spans and token merges are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each reads what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
