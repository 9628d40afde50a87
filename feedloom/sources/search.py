"""Product search by an index of trigrams: which products hold three characters in a row.

A product that holds a text holds all of its trigrams. Those few that hold the rarest of them are then looked at
for the text itself, so the result is that of a search through all products.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.groups import broadcast_if_small
from feedloom.operators.views import search_products
from feedloom.rules import CONTRACT, Rules
from feedloom.session import stage

GRAM = 3
BUCKETS = 64  # folders the trigrams are spread over
RAREST = 3  # trigrams of a search that are looked up


def grams(text: Column) -> Column:
    """The distinct trigrams of a text."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - (GRAM - 1), F.lit(1)))
    found = F.transform(places, lambda i: F.substring(text, i, F.lit(GRAM)))
    return F.array_distinct(F.filter(found, lambda g: F.length(g) == GRAM))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_index(products: DataFrame, path: str) -> None:
    """Trigrams of SKU and name in lower case, by folder and in order, and how many products hold each."""
    both = F.array_distinct(F.concat(grams(F.lower("sku")), grams(F.lower(F.coalesce("name", F.lit(""))))))
    held = products.select("catalog_id", "sku", F.explode(both).alias("gram"))
    placed = held.withColumn("bucket", _bucket(F.col("gram")))
    # A trigram of nearly all products is spread over tasks by range, like any other.
    dealt = placed.repartitionByRange("bucket", "gram", "catalog_id", "sku").sortWithinPartitions("bucket", "gram", "catalog_id", "sku")
    dealt.write.partitionBy("bucket").parquet(f"{path}/grams")
    counts = products.sparkSession.read.schema(placed.schema).parquet(f"{path}/grams").groupBy("gram", "bucket").agg(F.count("*").alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, query: str, catalog_id: int | None = None) -> DataFrame | None:
    """(catalog_id, sku) of the products that hold the rarest trigrams of a text; null for a text too short to have one."""
    parts = sorted({query[i : i + GRAM] for i in range(len(query) - GRAM + 1)})
    if not parts:
        return None
    known = spark.read.parquet(f"{path}/counts").filter(F.col("gram").isin(*parts)).orderBy("n", "gram").collect()
    index = spark.read.parquet(f"{path}/grams")
    if len(known) < len(parts):  # some trigram is in no product
        return index.select("catalog_id", "sku").limit(0)
    rarest = [r.gram for r in known[:RAREST]]
    held = index.filter(F.col("bucket").isin(*{r.bucket for r in known[:RAREST]}) & F.col("gram").isin(*rarest))
    if catalog_id is not None:
        held = held.filter(F.col("catalog_id") == catalog_id)
    return held.groupBy("catalog_id", "sku").agg(F.count("*").alias("n")).filter(F.col("n") == len(rarest)).drop("n")


def search_indexed(
    products: DataFrame, path: str, query: str, catalog_id: int | None = None, page: int = 1, per_page: int = 50, rules: Rules = CONTRACT
) -> DataFrame:
    """`search_products` with the index at `path`; a text of fewer than three characters is searched without it."""
    # Lower case as Spark makes it, so that index, search and products agree.
    needle = products.sparkSession.range(1).select(F.lower(F.lit(query))).first()[0]
    found = candidates(products.sparkSession, path, needle, catalog_id)
    if found is not None:
        products = products.join(broadcast_if_small(stage(found, "candidates")), ["catalog_id", "sku"], "left_semi")
    return search_products(products, query, catalog_id, page, per_page, rules)
