"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.session import new_folder, stage

__all__ = [
    "SPACES", "WORD_GAP", "beside", "let", "new_folder", "read_table", "small_enough", "stage", "text_batches", "unused", "words",
]

SPACES = " \t\n\x0b\x0c\r"  # the characters x20 and x09 to x0D, the only ones that part words
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` applied to `value`, which is evaluated once per row however often `body` names it."""
    return F.transform(F.array(value), body)[0]


BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def text_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once: batches sized for numbers would hold tens of thousands of texts."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = int(str(spark.conf.get(name)).removesuffix("b"))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def words(text: Column) -> Column:
    """The words of a text in order; no word for null, empty and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return let(
        trimmed,
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WORD_GAP)),
    )


def small_enough(stored: DataFrame, rows: int) -> bool:
    """Whether a stored table has at most `rows` rows; reads no more than one row beyond that."""
    return stored.limit(rows + 1).count() <= rows


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of `df`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def beside(docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`work` on `docs`, whose own columns of these names are kept out of its way and given back."""
    own = [c for c in docs.columns if c.lower() in names]
    away = dict(zip(own, unused(docs, *[f"_llm_{c}" for c in own]), strict=True))
    back = {new: old for old, new in away.items()}
    return work(docs.withColumnsRenamed(away)).drop(*names).withColumnsRenamed(back).select(docs.columns)
