"""The registered queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairsieve.llm.common import documents
from pairsieve.llm.conversations import repair_conversations
from pairsieve.llm.exact import exact_dedup
from pairsieve.llm.grammar import grammar_round_trip
from pairsieve.llm.jaccard import jaccard_components
from pairsieve.llm.langid import language_id
from pairsieve.llm.licenses import scan_licenses
from pairsieve.llm.lm import score_documents
from pairsieve.llm.mixing import mix_sources
from pairsieve.llm.packing import best_fit_packing
from pairsieve.llm.phrases import fingerprints
from pairsieve.llm.secrets import find_secrets
from pairsieve.llm.suffixes import remove_repeats
from pairsieve.llm.whitening import whiten


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op3_grammar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar_round_trip(documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))


def op10_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


QUERIES = {
    "op1_lm_scores": op1_lm_scores,
    "op2_mix_sources": op2_mix_sources,
    "op3_grammar_files": op3_grammar_files,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_language_id": op7_language_id,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_secret_scan": op9_secret_scan,
    "op10_phrase_fingerprints": op10_phrase_fingerprints,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_license_scan": op13_license_scan,
}

SQL = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
