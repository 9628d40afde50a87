"""A training-data pipeline over the documents table: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import decontamination, jaccard_join, language_id, pii, piece_encoding
from feedloom.llm.common import beside, new_folder, read_table

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; `lang` stays as it is. Learnt from the rows that have a language."""
    model = language_id.fit(docs)

    def told(rows: DataFrame) -> DataFrame:
        return language_id.identify(rows, model).filter(F.col("lang_pred") != language_id.UNKNOWN)

    return beside(docs, ("lang_pred", "score"), told)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one with the smallest id."""
    return jaccard_join.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by pseudonyms; `n_chars` counts the new text."""

    def replaced(rows: DataFrame) -> DataFrame:
        changed = F.when(F.col("n_pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        return pii.replace_pii(rows).withColumn("n_chars", changed)

    return beside(docs, ("n_pii",), replaced)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they stand for: doc_id, n_tokens, ids, text, round_trip."""
    return piece_encoding.round_trip(docs, PIECE_BPE)


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_copies),
    ("decontamination", benchmark_leaks),
    ("pii", personal_data),
    ("piece_encoding", pieces),
]

# MinHash, character n-gram models and piece merging are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
