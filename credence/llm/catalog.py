"""The registered queries of this folder and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import languages, oracles, toxicity
from credence.llm.curriculum import MIX_SQL, mixed_documents
from credence.llm.debruijn import remove_repeats
from credence.llm.decontamination import LEAKS_SQL, leaks
from credence.llm.jaccard import jaccard_components
from credence.llm.negatives import NEGATIVES_SQL, hard_negatives
from credence.llm.neighbours import nearest
from credence.llm.packing import pack_documents
from credence.llm.suffixes import remove_copies
from credence.llm.textkit import table, text_crc
from credence.llm.token_counts import count_tokens
from credence.llm.tries import TRIE_SQL, rebuilt_trie
from credence.llm.warc import archive_pages


def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents", "doc_id", "text"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text"))


def op3_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_copies(table(spark, folder, "documents", "doc_id", "text"))


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents", "doc_id", "text"))


def op5_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    held_out = text_crc("doc_id") % 3 == 1
    found = languages.identify(docs, *languages.train(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "labels", "doc_id", "toxic")
    held_out = text_crc("doc_id") % 5 == 0
    found = toxicity.score(docs, *toxicity.train(docs, labels, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    _, index = archive_pages(table(spark, folder, "pages", "page_id", "url", "html"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixed_documents(table(spark, folder, "documents", "doc_id", "text", "source"))


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return rebuilt_trie(table(spark, folder, "conversations", "conv_id", "turn", "role", "text")).drop("key", "parent_key")


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(table(spark, folder, "embeddings", "vec_id", "embedding", "label"), F.col("vec_id") % 50 == 0, moved)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_decontamination": op2_decontamination,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
    "op11_curriculum_mix": op11_curriculum_mix,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL: dict[str, str] = {
    "op1_ngram_jaccard": oracles.JACCARD_SQL,
    "op2_decontamination": LEAKS_SQL,
    "op3_suffix_array_dedup": oracles.COPIED_BYTES_SQL,
    "op4_substring_dedup": oracles.REPEATED_WORDS_SQL,
    "op10_warc": oracles.ARCHIVES_SQL,
    "op11_curriculum_mix": MIX_SQL,
    "op12_conversation_trie": TRIE_SQL,
    "op13_hard_negatives": NEGATIVES_SQL,
}
