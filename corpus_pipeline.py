"""A corpus job whose stages each take and return the documents table.

The last stage returns packed pieces instead. Between stages the table is written and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm.decontamination import without_leaks
from credence.llm.jaccard import one_of_each_group
from credence.llm.languages import accepted, train
from credence.llm.packing import pack_documents
from credence.llm.suffixes import without_copies
from credence.llm.textkit import bound_batches, table
from credence.session import settle

# Texts without a language are rejected, and those whose best language is not even as likely as all others together.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the labelled ones among them; others go."""
    bound_batches(spark)
    return accepted(docs, *train(docs, F.lit(True)), LEAST_SCORE)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similar shingle sets: the one of least doc_id."""
    bound_batches(spark)
    return one_of_each_group(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that start earlier too; n_chars follows."""
    bound_batches(spark)
    return without_copies(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    bound_batches(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard", jaccard_stage),
    ("suffix_array_dedup", suffix_stage),
    ("decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

# Language identification and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
