"""Encoding, delimiter and header detection for many files at once.

Everything happens inside the row of a file, over a sample of bounded size, so a folder of any number
of files is detected in one pass with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.csvtext import first_lines, split_lines, split_record
from feedloom.functions.encoding import decode_lenient, detect_encoding, sample_of
from feedloom.functions.text import js_trim
from feedloom.operators.mapping import read_headers
from feedloom.rules import DELIMITERS, SAMPLE_BYTES, SAMPLE_RECORDS


def whole_records(text: Column) -> Column:
    """Cut a sample after its last line break; a sample without one stays whole."""
    kept = F.regexp_extract(text, "(?s)\\A(.*\\n)", 1)
    return F.when(kept == "", text).otherwise(kept)


def _all_blank(cells: Column) -> Column:
    return js_trim(F.array_join(cells, "")) == ""


def column_counts(text: Column, delimiter: str, records: int = SAMPLE_RECORDS) -> Column:
    """Cells per record for the first records of a sample, blank records left out."""
    cells = F.transform(first_lines(text, delimiter, records), lambda line: split_record(line, delimiter))
    return F.transform(F.filter(cells, lambda c: ~_all_blank(c)), F.size)


def sampled(files: DataFrame, size: int = SAMPLE_BYTES) -> DataFrame:
    """files (…, content) -> the sample's encoding and whole-record text."""
    with_encoding = files.withColumn("_sample", sample_of(F.col("content"), size)).withColumn(
        "encoding", detect_encoding(F.col("_sample"))
    )
    return with_encoding.withColumn(
        "sample_text", whole_records(decode_lenient(F.col("_sample"), F.col("encoding")))
    ).drop("content", "_sample")


def candidate_counts(samples: DataFrame) -> DataFrame:
    """Add `candidates`: per delimiter its precedence and cells per record."""
    candidates = [
        F.struct(
            F.lit(rank).alias("rank"),
            F.lit(d).alias("delimiter"),
            column_counts(F.col("sample_text"), d).alias("counts"),
        )
        for rank, d in enumerate(DELIMITERS, 1)
    ]
    return samples.withColumn("candidates", F.array(*candidates))


def _mode(counts: Column) -> Column:
    """struct<records, columns> of the commonest count; more columns win a tie."""
    return F.array_max(
        F.transform(
            F.array_distinct(counts),
            lambda n: F.struct(
                F.size(F.filter(counts, lambda other: other == n)).alias("records"), n.alias("columns")
            ),
        )
    )


def delimiter_histogram(counted: DataFrame, key: str) -> DataFrame:
    """(key, delimiter, n_columns, n_records) for every candidate."""
    each = counted.select(key, F.explode("candidates").alias("c")).select(
        key,
        "c.delimiter",
        F.explode(
            F.transform(
                F.array_distinct("c.counts"),
                lambda n: F.struct(
                    n.alias("n_columns"),
                    F.size(F.filter("c.counts", lambda other: other == n)).alias("n_records"),
                ),
            )
        ).alias("h"),
    )
    return each.select(key, "delimiter", "h.n_columns", "h.n_records")


def delimiter_scores(counted: DataFrame) -> DataFrame:
    """Add `scores`: records of the commonest shape, zero for candidates that never split a record."""

    def score(c: Column) -> Column:
        mode = _mode(c["counts"])
        qualifies = F.coalesce(mode["columns"] >= 2, F.lit(False))
        return F.struct(
            F.when(qualifies, mode["records"]).otherwise(0).alias("score"),
            (-c["rank"]).alias("precedence"),
            c["delimiter"].alias("delimiter"),
            mode["columns"].alias("n_columns"),
        )

    return counted.withColumn("scores", F.transform("candidates", score))


def detect_feeds(files: DataFrame, size: int = SAMPLE_BYTES) -> DataFrame:
    """files (…, content) -> encoding, delimiter, delimiter_uncertain, headers."""
    scored = delimiter_scores(candidate_counts(sampled(files, size)))
    best = scored.withColumn("_best", F.array_max("scores"))
    known = F.col("_best.score") > 0
    chosen = best.withColumn("delimiter", F.when(known, F.col("_best.delimiter")).otherwise(F.lit(","))).withColumn(
        "delimiter_uncertain", ~known
    )
    return chosen.withColumn("headers", header_cells(F.col("sample_text"), F.col("delimiter"))).drop(
        "sample_text", "candidates", "scores", "_best"
    )


def header_cells(text: Column, delimiter: Column) -> Column:
    """Cleaned cells of the first record that is not blank; empty when there is none."""

    def first_filled(lines: Column, d: str) -> Column:
        return F.get(F.filter(F.transform(lines, lambda line: split_record(line, d)), lambda c: ~_all_blank(c)), F.lit(0))

    found = F.lit(None).cast("array<string>")
    for d in DELIMITERS:
        near = first_filled(first_lines(text, d, SAMPLE_RECORDS), d)
        # Only a sample that opens with that many blank records is cut up as a whole.
        found = F.when(delimiter == d, F.coalesce(near, first_filled(split_lines(text, d), d))).otherwise(found)
    return F.coalesce(read_headers(found), F.array().cast("array<string>"))
