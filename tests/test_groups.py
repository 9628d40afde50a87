"""Blocked windows against plain windows, with blocks small enough that groups span many."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from feedloom.operators import groups
from feedloom.operators.groups import block_of, number_rows, previous_value, previous_written, spread_join


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for n in range(1, 1200):
        group = "hot" if rng.random() < 0.5 else f"g{rng.randrange(20)}"
        written = (rng.choice([None, "x", str(n)]),) if rng.random() < 0.3 else None
        data.append((group, n, f"h{rng.randrange(5)}", written))
    return spark.createDataFrame(data, "g string, n bigint, h string, w struct<v:string>").cache()


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_number_rows(rows, size):
    got = number_rows(rows.select("g", "n"), ["g"], block_of("n", size), ["n"], "place")
    want = rows.select("g", "n", F.row_number().over(Window.partitionBy("g").orderBy("n")).cast("bigint").alias("place"))
    assert same(got, want)


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_previous_value(rows, size):
    window = Window.partitionBy("g").orderBy("n")
    slim = rows.select("g", "n", "h")
    for value in ("h", "n"):
        got = previous_value(slim, ["g"], block_of("n", size), ["n"], value, "before")
        assert same(got, slim.withColumn("before", F.lag(value).over(window)))


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_previous_written(rows, size):
    window = Window.partitionBy("g").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    got = previous_written(rows, ["g"], block_of("n", size), ["n"], ["w"])
    assert same(got, rows.withColumn("old_w", F.last("w", ignorenulls=True).over(window)))


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_spread_join_beyond_broadcast(spark, rows, how, monkeypatch):
    dims = spark.createDataFrame([("hot", 1), ("g1", 2), ("other", 3)], "g string, d int")
    want = rows.select("g", "n").join(dims, "g", how)
    small = spread_join(rows.select("g", "n"), dims, "g", F.col("n"), how)
    monkeypatch.setattr(groups, "is_small", lambda dimension, rows=0: False)
    large = spread_join(rows.select("g", "n"), dims, "g", F.col("n"), how)
    assert same(small, want) and same(large, want)


def test_dimensions_of_many_rows_are_sent_along(spark):
    assert groups.is_small(spark.range(200_000))
    assert not groups.is_small(spark.range(20), 10) and not groups.is_small(spark.range(20), size=10)
