"""Listing, admitting and verifying feed files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.rules import FILE_CAP_BYTES, SAMPLE_BYTES
from feedloom.session import stage
from feedloom.sources.ranges import head_of, sha256_of, size_of


FILES_AT_ONCE = 64  # files whose values a task holds: heads of 64 KB come to 4 MB


def per_file(files: DataFrame, read: Callable[[str], object], name: str, kind: str) -> DataFrame:
    """`files` with what `read` returns for the path of each, in as many tasks as the session has room for.

    The rows are small and the work behind each is not, so they are not dealt out by their bytes.
    """
    spark = files.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = [c for c in files.columns if c != name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), FILES_AT_ONCE):
                rows = batch.iloc[at : at + FILES_AT_ONCE].copy()
                rows[name] = pd.Series([read(path) for path in rows["path"]], index=rows.index, dtype=object)
                yield rows

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*kept).schema)
    return files.select(*kept).repartition(tasks).mapInPandas(run, f"{fields}, {name} {kind}")


def listing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, size) of every file; no file is opened, and what was found is stored.

    Spark's readers pass over files without bytes. Only where the index that its listing made counts more files than were
    read, they are taken from there: the names of all files pass through the driver then.
    """
    files = spark.read.format("binaryFile").load(path)
    found = stage(files.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size")), "listing")
    if found.count() == len(files._jdf.inputFiles()):
        return found
    index = spark.createDataFrame([(re.sub("^file:/+", "file:/", p), 0) for p in files.inputFiles()], "path string, size bigint")
    return found.unionByName(index.join(found, "path", "left_anti"))


def list_feeds(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, size, sha256) of every file, empty ones included; a file of any size is hashed a block at a time."""
    return with_hash(listing(spark, path))


def with_hash(files: DataFrame) -> DataFrame:
    """`files` (path, …) with the sha256 that each has now; null for one that is gone."""
    return per_file(files, sha256_of, "sha256", "string")


def with_size(files: DataFrame) -> DataFrame:
    """`files` (path, …) with the size that each has now; null for one that is gone."""
    return per_file(files, size_of, "size", "bigint")


def feed_samples(spark: SparkSession, path: str | list[str], size: int = SAMPLE_BYTES) -> DataFrame:
    """(path, content) with the head of every file, as detection wants it; no more of a file is read."""
    return per_file(listing(spark, path).select("path"), lambda p: head_of(p, size), "content", "binary")


def admission(size: Column, cap: int = FILE_CAP_BYTES) -> Column:
    """Null for a file that may be loaded, else the code it is refused with."""
    return F.when(size == 0, F.lit("validation_failed")).when(size > cap, F.lit("file_too_large"))


def admit(files: DataFrame, cap: int = FILE_CAP_BYTES) -> DataFrame:
    """A listing (path, size, …) with the code that refuses a file, null for one that may be loaded."""
    return files.withColumn("code", admission(F.col("size"), cap))


def file_integrity(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports whose stored file is gone or no longer has the recorded hash."""
    found = files.select("path", F.col("sha256").alias("found_sha256"))
    changed = F.coalesce(F.col("found_sha256") != F.col("file_sha256"), F.lit(True))
    return (
        imports.join(found, "path", "left")
        .filter(changed)
        .select("import_id", "path", F.lit("failed").alias("state"), F.lit("file_missing").alias("pause_reason"))
    )


def changed_files(imports: DataFrame) -> DataFrame:
    """The same for imports (import_id, path, file_sha256), by a look at their own files instead of a listing.

    An import without a recorded hash is not looked at.
    """
    recorded = imports.filter("file_sha256 is not null").select("import_id", "path", "file_sha256")
    return file_integrity(recorded, with_hash(recorded.select("path").distinct()))
