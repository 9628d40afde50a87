"""Ordered work inside groups that may be arbitrarily large.

One feed, or one SKU of one catalog, can hold a large share of all rows, so no group is ever sorted
as a whole. Every group is cut into blocks along its order; windows run inside (group, block), and a
summary with one row per block, aggregated on the map side, carries state across block borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1_000_000  # row numbers per block of one import
BLOCK_IMPORTS = 64  # imports per block of one catalog key
SPREAD = 16  # copies of a dimension row in a spread join
BROADCAST_ROWS = 1_000_000  # rows, and
BROADCAST_BYTES = 128 << 20  # bytes as text, up to which a dimension is broadcast


def block_of(number: str | Column, size: int) -> Column:
    number = F.col(number) if isinstance(number, str) else number
    return F.call_function("div", number, F.lit(size).cast("bigint"))


def number_rows(
    df: DataFrame, group: Sequence[str], block: Column, order: Sequence[str | Column], name: str
) -> DataFrame:
    """Add the 1-based position of each row in its group; `block` must not decrease along `order`."""
    df = df.withColumn("_block", block)
    keys = [*group, "_block"]
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .filter("_start > 0")
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        df.withColumn("_inside", inside)
        .join(starts, keys, "left")
        .withColumn(name, F.col("_inside") + F.coalesce("_start", F.lit(0).cast("bigint")))
        .drop("_block", "_inside", "_start")
    )


def previous_value(
    df: DataFrame, group: Sequence[str], block: Column, order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Add `value` of the row before this one in its group (null at the group's first row).

    `value` itself must not be null.
    """
    df = df.withColumn("_block", block)
    keys = [*group, "_block"]
    if list(order) == [value]:
        last = F.max(value)
    else:
        last = F.max(F.struct(*order, value))[value]
    carried = (
        df.groupBy(*keys)
        .agg(last.alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*group).orderBy("_block")))
        .filter("_carry is not null")
        .drop("_last")
    )
    inside = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return (
        df.withColumn("_inside", inside)
        .join(carried, keys, "left")
        .withColumn(name, F.coalesce("_inside", "_carry"))
        .drop("_block", "_inside", "_carry")
    )


def previous_written(
    df: DataFrame, group: Sequence[str], block: Column, order: Sequence[str], written: Sequence[str]
) -> DataFrame:
    """Replace each `written` struct column by its latest non-null value on earlier rows.

    Results are named `old_<column>`; the inputs stay.
    """
    df = df.withColumn("_block", block)
    keys = [*group, "_block"]
    at = F.struct(*order)
    earlier_blocks = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = df.groupBy(*keys).agg(
        *[F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v")))).alias(c) for c in written]
    )
    carried = carried.select(
        *keys, *[F.last(f"{c}.v", ignorenulls=True).over(earlier_blocks).alias(f"_carry_{c}") for c in written]
    ).filter(F.greatest(*[F.col(f"_carry_{c}").isNotNull().cast("int") for c in written], F.lit(0)) > 0)
    earlier_rows = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.select(
        "*", *[F.last(c, ignorenulls=True).over(earlier_rows).alias(f"_inside_{c}") for c in written]
    )
    joined = inside.join(carried, keys, "left")
    return joined.select(
        *[c for c in df.columns if c != "_block"],
        *[F.coalesce(f"_inside_{c}", f"_carry_{c}").alias(f"old_{c}") for c in written],
    )


def is_small(dimension: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a dimension is within both bounds, told by one aggregate that moves none of its rows."""
    width = F.octet_length(F.to_json(F.struct(*dimension.columns)))
    found = dimension.agg(F.count("*").alias("n"), F.sum(width).alias("bytes")).first()
    return found["n"] <= rows and (found["bytes"] or 0) <= size


def broadcast_if_small(dimension: DataFrame) -> DataFrame:
    """Hint a broadcast for a dimension counted to be small; a bigger one joins by shuffle."""
    return F.broadcast(dimension) if is_small(dimension) else dimension


def spread_join(
    rows: DataFrame, dimension: DataFrame, on: str | Sequence[str], salt: Column, how: str = "inner"
) -> DataFrame:
    """Join rows to a dimension with one row per key without gathering a hot key in one task.

    A dimension counted to be small is broadcast, so the rows do not move. Beyond that each key's rows
    are spread over `SPREAD` sub-keys, against as many copies of its dimension row. The dimension is
    evaluated for the count: pass a stored or staged one.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if is_small(dimension):
        return rows.join(F.broadcast(dimension), keys, how)
    copies = dimension.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    salted = rows.withColumn("_salt", F.pmod(salt, F.lit(SPREAD)).cast("int"))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


HEAVY_KEYS = 64  # a key that one task could not share out holds more than one in so many rows


def heavy_keys(rows: DataFrame, key: Column, share: int = HEAVY_KEYS) -> list[int]:
    """Hashes of the keys that hold more than one in `share` of all rows, and perhaps of some that hold less.

    A sketch of frequent items, merged over the partitions, finds them in one pass; there are at most `share` of them.
    """
    hashed = rows.select(F.xxhash64(key).alias("_key")).filter(key.isNotNull())
    top = F.call_function("approx_top_k", F.col("_key"), F.lit(share), F.lit(16 * share))
    found = hashed.agg(top.alias("top"), F.count("*").alias("n")).first()
    return [item["item"] for item in found["top"] or [] if item["count"] * share > found["n"]]


def heavy_join(rows: DataFrame, dimension: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join rows to a dimension with one row per key: rows of heavy keys stay where they are, the rest is shuffled.

    The few dimension rows of heavy keys are sent to every task, so no task gets more than a share of the rows that the
    sketch allows. `how` is `left` or `inner`; `rows` is read twice: pass a stored one. Null keys match nothing
    and stay where they are too.
    """
    if is_small(dimension):
        return rows.join(F.broadcast(dimension), on, how)
    heavy = heavy_keys(rows, F.col(on))
    hot = lambda df: F.xxhash64(df[on]).isin(*heavy) if heavy else F.lit(False)
    apart = F.coalesce(hot(rows), F.lit(False)) | rows[on].isNull()
    few = rows.filter(apart).join(F.broadcast(dimension.filter(hot(dimension))), on, how)
    return few.unionByName(rows.filter(~apart).join(dimension, on, how))
