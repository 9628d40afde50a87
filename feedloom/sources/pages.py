"""Pages of long lists: rows laid out in their order, so that any page is found without reading the ones before it.

Rows are numbered block by block in the order they are shown in and stored in chunks, with a small table beside them that counts the rows
of each chunk by the columns a list may be narrowed by. A page is looked up in the counts, which give the total as well,
and only the chunks it lies in are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 10_000


def write_pages(
    rows: DataFrame, path: str, group: str, block: Column, order: Sequence[str], narrow: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS
) -> None:
    """Lay out `rows` by `group` and `order`; `block` must not decrease along the order, as for `number_rows`.

    Rows are worked out and moved once, and a list takes no folder or file of its own: a file holds the blocks of many, in order.
    Lists may be narrowed by the values of the columns `narrow`.
    """
    placed = rows.withColumn("_block", block)
    inside = F.row_number().over(Window.partitionBy(group, "_block").orderBy(*order))
    numbered = placed.withColumn("position", inside)
    chunked = numbered.withColumn("chunk", F.call_function("div", F.col("position") - 1, F.lit(chunk_rows).cast("bigint")))
    chunked.write.option("compression", "zstd").parquet(f"{path}/rows")
    written = rows.sparkSession.read.schema(chunked.schema).parquet(f"{path}/rows")
    counts = written.groupBy(group, "_block", "chunk", *narrow).agg(F.count("*").alias("n"))
    counts.repartitionByRange(group, "_block", "chunk").sortWithinPartitions(group, "_block", "chunk").write.parquet(f"{path}/counts")


def read_page(
    spark: SparkSession, path: str, group: str, value, page: int = 1, per_page: int = 50, **narrowed: str | None
) -> DataFrame:
    """Page `page` of the rows of one group, in their order, with the number of all of them as `total`.

    At most `per_page` chunks are asked for: those that hold a row of the page. The files are sorted by list and chunk, so their
    statistics leave out the rest.
    """
    wanted = {c: v for c, v in narrowed.items() if v is not None}

    def chosen(df: DataFrame) -> DataFrame:
        for column, v in {group: value, **wanted}.items():
            df = df.filter(F.col(column) == v)
        return df

    first = (max(1, page) - 1) * per_page
    counts, place = spark.read.parquet(f"{path}/counts"), ("_block", "chunk")
    each = chosen(counts).groupBy(*place).agg(F.sum("n").alias("n"))
    upto = Window.orderBy(*place)  # a row for each chunk of one list
    placed = each.withColumn("_end", F.sum("n").over(upto)).withColumn("_all", F.sum("n").over(Window.partitionBy()))
    hit = placed.filter((F.col("_end") > first) & (F.col("_end") - F.col("n") < first + per_page)).orderBy(*place).collect()
    named = F.lit(False)
    for r in hit:
        named = named | (F.col("_block").eqNullSafe(r["_block"]) & (F.col("chunk") == r.chunk))
    rows = chosen(spark.read.parquet(f"{path}/rows").filter(named))
    skipped = hit[0]["_end"] - hit[0]["n"] if hit else 0
    total = F.lit(hit[0]["_all"] if hit else 0).cast("bigint")
    shown = rows.orderBy("_block", "position").offset(first - skipped if hit else 0).limit(per_page)
    return shown.withColumn("total", total).drop("_block", "chunk", "position")
