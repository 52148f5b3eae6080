"""A training corpus out of documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns
documents with the same columns; the last returns the packed pieces.  ``run`` writes each
stage's result to the shared folder and gives it to the next.  Stages that send texts to Python
make the session's Arrow batches small (``small_batches``), and leave them so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tomeloom.llm import exact_dedup, langid, mixing, packing
from tomeloom.llm import near as near_copies
from tomeloom.llm.arrow import small_batches
from tomeloom.llm.queries import tokenizer_path
from tomeloom.llm.store import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; null texts and texts without a letter go."""
    small_batches(spark)
    return langid.drop_rejected(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts (white space apart), the smallest id's; null is an empty text,
    rows without an id come last."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that share 0.8 of their five-word shingles with a smaller id's; rows without an
    id come last, and different texts of one id are different documents."""
    small_batches(spark)
    return near_copies.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: rows repeat for epochs, and one copy may be cut; null is a source
    of its own, and rows of one id are taken each for itself."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; a null text is one end mark, and an empty table gives none."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("packed", packed)]

#: Language models, fingerprints and token ids are beyond SQL; tests hold run() against a
#: brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
