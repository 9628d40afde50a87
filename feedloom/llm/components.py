"""Connected components of an edge table, distributed: alternating large-star and small-star rounds.

Each round is two aggregations and two joins on the edges; none gathers a component. Rounds are written
to the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written first, so that both sides of the join are plain shuffles: the edges of a hub can then be split.
    least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, left: str, right: str, rounds: int = 100) -> DataFrame:
    """Rows (node, component) for every node of an edge; the component is its smallest node.

    Null ends and loops are left out, repeated edges count once, an empty table gives an empty result.
    Raises if `rounds` rounds do not settle (their number grows with the logarithm of the node count).
    """
    state = stage(
        edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .distinct(),
        "edges",
    )

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    seen = mark(state)
    if seen[0] == 0:
        return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(rounds):
        state = stage(_small_star(_large_star(state)), "stars")
        now = mark(state)
        if now == seen:
            roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        seen = now
    raise RuntimeError(f"components not settled after {rounds} rounds")
