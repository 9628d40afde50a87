"""Session defaults and the shared folder used for staged tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# The values a job of this library wants; a cluster's own submit settings win over them.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str | None = None, app: str = "feedloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Row rules make wide projections. Generated methods above the JVM's own limit for compiling run
# interpreted, so Spark is told to split such stages instead. Feeds are many files, each in a folder of its own; by default
# listing them takes up to 10,000 tasks, which cost more than the listing.
RUNTIME = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256"}


def configure(spark: SparkSession) -> None:
    """Settings of this library that a running session still takes."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach; one of our own only where the session names none."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="feedloom-")  # one machine, one folder
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set(CHECKPOINT_CONF, folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/feedloom/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and read it back.

    Used where several consumers need the same expensive rows: each then reads only the columns
    it needs, and a lost executor re-reads files instead of recomputing the parse.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)  # hashes and ids, much of what is staged, do not shrink by matches alone
    return spark.read.schema(df.schema).parquet(path)
