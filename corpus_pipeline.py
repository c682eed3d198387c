"""Training-data pipeline over ``documents``: five stages, each on all that the one before it
kept. Every stage but the last returns the columns of documents."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seqscore.llm import langid, packing, simhash, suffixes, toxicity
from seqscore.llm.common import ensure_checkpoint_dir, held_out, table
from seqscore.session import ship_package

TOKENIZER = "word_bpe_49k.json"


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones show; null and letterless texts go."""
    ship_package(spark)
    return langid.known_language(docs, langid.learn(docs.where(~held_out())))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3."""
    ship_package(spark)
    return toxicity.harmless(docs, toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out())))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints link at 3 or fewer bits."""
    ship_package(spark)
    return simhash.one_of_each(docs, width=3, most=3)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that start in a document of smaller id."""
    ship_package(spark)
    return suffixes.without_repeats(docs, 50)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), 2048)


STAGES = [("language", known_languages), ("toxicity", not_toxic), ("near duplicates", near_copies),
          ("repeated passages", repeated_passages), ("packing", packed)]

#: Trained models, token ids and repeated byte strings are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
