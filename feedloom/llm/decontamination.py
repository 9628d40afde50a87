"""Benchmark decontamination by spaced seeds.

Fixed masks over ten tokens ignore some positions, so a hash of the others still agrees where a token was
exchanged. Hashes of all positions of documents and benchmark items are joined; every hit names an item and a
shift, and around it the overlap is compared token by token. A document is contaminated by an item if some
stretch of 13 tokens (or the whole item, if shorter) agrees in at least 80 % of its tokens. Only DataFrame
functions run.

No stretch is missed: the masks are as many as hit every exchange of tokens that the rule allows in the shortest
item of ten or more tokens, and an item of fewer is sought whole, with each of its tokens left out in turn where
the rule allows one exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import let, small_enough, stage, unused

# The positions each mask looks at, and how many of the masks are needed for a stretch of so many tokens.
MASKS = (
    (0, 1, 3, 6, 8, 9), (0, 2, 3, 4, 7, 9), (0, 1, 4, 5, 6, 9), (2, 4, 6, 7, 8, 9), (0, 2, 3, 4, 6, 8), (0, 1, 2, 5, 7, 8),
    (1, 3, 4, 5, 8, 9), (1, 2, 3, 5, 6, 7), (0, 3, 5, 6, 7, 8),
)
NEEDED = {10: 9, 11: 5, 12: 4, 13: 3}
SPAN = 10
STRETCH = 13
SIMILARITY = 0.8
BROADCAST_SEEDS = 250_000  # hashes of the benchmark (16 bytes each) up to which they are broadcast
BROADCAST_ITEMS = 2_000  # items up to which their tokens are broadcast, if they are short
BROADCAST_TOKENS = 500_000
GAP = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), GAP)
    return F.array_remove(parts, "")


def whole_masks(n: int) -> tuple[tuple[int, ...], ...]:
    """Masks over a whole item of `n` tokens, fewer than ten: all but one each from five tokens on, where one may differ."""
    if n - math.ceil(n * SIMILARITY) == 0:
        return (tuple(range(n)),)
    return tuple(tuple(j for j in range(n) if j != out) for out in range(n))


def seeds(found: Column, span: int, masks: tuple[tuple[int, ...], ...], first: int = 0) -> Column:
    """For each place at which the masks fit, one hash per mask, one after the other; `first` numbers the masks."""

    def at(h: Column) -> Column:
        n = F.size(h)
        places = F.when(n >= span, F.sequence(F.lit(0), n - span)).otherwise(F.array().cast("array<int>"))
        return F.flatten(
            F.transform(
                places,
                lambda i: F.array(*[F.xxhash64(F.lit(first + k), *[F.get(h, i + j) for j in mask]) for k, mask in enumerate(masks)]),
            )
        )

    return let(F.transform(found, lambda t: F.xxhash64(t)), at)


def _places(df: DataFrame, keys: list[str], sizes: list[int], items: bool = False) -> DataFrame:
    """Seeds by place, for items of the given sizes; an item itself has only those of its own size."""
    long = [n for n in sizes if n >= SPAN]
    shapes = [(SPAN, MASKS[: NEEDED[min(min(long), STRETCH)]], 0)] if long else []
    shapes += [(n, whole_masks(n), 100 * n) for n in sizes if 0 < n < SPAN]
    out = None
    for span, masks, first in shapes:
        own = df.filter(F.size("_tokens") == span) if items and span < SPAN else df
        listed = own.select(*keys, F.posexplode(seeds(F.col("_tokens"), span, masks, first)).alias("_n", "_seed"))
        listed = listed.select(*keys, F.call_function("div", F.col("_n"), F.lit(len(masks))).alias("_place"), "_seed")
        out = listed if out is None else out.unionByName(listed)
    return df.select(*keys, F.lit(0).cast("long").alias("_place"), F.lit(0).cast("long").alias("_seed")).limit(0) if out is None else out


def _agrees(item: Column, doc: Column, shift: Column) -> Column:
    """Whether some stretch of the item, laid over the document at `shift`, agrees well enough."""
    width = F.least(F.lit(STRETCH), F.size(item))
    least = F.ceil(width * SIMILARITY)
    first = F.greatest(F.lit(0), -shift)
    last = F.least(F.size(item), F.size(doc) - shift) - width  # the last start of a stretch

    def any_start(same: Column) -> Column:
        return F.exists(
            F.sequence(F.lit(0), last - first),
            lambda s: F.aggregate(F.slice(same, s + 1, width), F.lit(0), lambda a, x: a + x) >= least,
        )

    same = F.transform(
        F.sequence(first, last + width - 1),
        lambda j: (F.get(item, j) == F.get(doc, j + shift)).cast("int"),
    )
    return F.when(last >= first, let(same, any_start)).otherwise(F.lit(False))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, _text_hash, item_id) for every row of `docs` and every item that contaminates it, once each.

    Rows are told apart by id and hash of the text, so repeated rows share a result and rows that only share an id
    do not; a null id is an id. Null texts, and texts and items without a token, have no hits.
    """
    keys = ["doc_id", "_text_hash"]
    read = docs.select("doc_id", F.xxhash64("text").alias("_text_hash"), tokens(F.col("text")).alias("_tokens"))
    bench = stage(items.select("item_id", tokens(F.col("text")).alias("_tokens")).distinct(), "items")
    sizes = sorted(bench.agg(F.collect_set(F.least(F.size("_tokens"), F.lit(STRETCH)))).first()[0])
    bench_seeds = _places(bench, ["item_id"], sizes, items=True).withColumnRenamed("_place", "_item_place")
    bench_seeds = stage(bench_seeds.distinct(), "seeds")
    probe = F.broadcast(bench_seeds) if small_enough(bench_seeds, BROADCAST_SEEDS) else bench_seeds
    hits = _places(read, keys, sizes).join(probe, "_seed")
    hits = hits.select(*keys, "item_id", (F.col("_place") - F.col("_item_place")).cast("int").alias("_shift")).distinct()
    hits = stage(hits, "hits")

    short = small_enough(bench, BROADCAST_ITEMS) and (bench.agg(F.sum(F.size("_tokens"))).first()[0] or 0) <= BROADCAST_TOKENS
    bench = bench.withColumnsRenamed({"_tokens": "_item_tokens", "item_id": "_item"})
    bench = F.broadcast(bench) if short else bench
    hits = hits.withColumnsRenamed({"doc_id": "_doc", "_text_hash": "_hash"})
    near = read.join(hits, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_hash")))
    near = near.join(bench, F.col("item_id").eqNullSafe(F.col("_item")))
    verified = near.filter(_agrees(F.col("_item_tokens"), F.col("_tokens"), F.col("_shift")))
    return verified.select(*keys, "item_id").distinct()


def _joined(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    doc, text_hash = unused(docs, "_doc", "_hash")
    found = found.withColumnsRenamed({"doc_id": doc, "_text_hash": text_hash})
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text_hash))
    return docs.join(found, same, how)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, contaminated, and how many items contaminate it."""
    found = leaks(docs, items).groupBy("doc_id", "_text_hash").agg(F.count("*").alias("n_items"))
    joined = _joined(docs.select("doc_id", "text"), stage(found, "leaks"), "left")
    n = F.coalesce("n_items", F.lit(0)).cast("long")
    return joined.select("doc_id", (n > 0).alias("contaminated"), n.alias("n_items"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` that no item contaminates, with all their columns."""
    found = stage(leaks(docs, items).select("doc_id", "_text_hash").distinct(), "leaks")
    return _joined(docs, found, "left_anti")


