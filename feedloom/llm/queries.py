"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import (
    decontamination,
    fingerprints,
    jaccard_join,
    language_id,
    piece_encoding,
    pii,
    prefix_trie,
    quality_rules,
    secret_scans,
    substring_dedup,
    token_alignment,
    token_output,
    url_filters,
)
from feedloom.llm.common import new_folder, read_table
from feedloom.llm.sql import ORACLE

__all__ = ["ORACLE", "QUERIES"]

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_digest(read_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encoding.round_trip(read_table(spark, sf_dir, "documents"), PIECE_BPE)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_digest(read_table(spark, sf_dir, "documents"), new_folder(spark, "tokens"), BYTE_BPE)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_held_out(read_table(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.secret_digest(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.join_similar(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge_urls(read_table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(read_table(spark, sf_dir, "conversations"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_digest(read_table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_digest(read_table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_pii": op3_pii,
    "op4_piece_encoding": op4_piece_encoding,
    "op5_token_output": op5_token_output,
    "op6_language_id": op6_language_id,
    "op7_secret_scans": op7_secret_scans,
    "op8_decontamination": op8_decontamination,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_url_filters": op10_url_filters,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_fingerprints": op12_fingerprints,
    "op13_token_alignment": op13_token_alignment,
}
