"""Counts of what lies within some steps, against the listed search."""

import random

import pytest
from ledgerwing.operators import graph
from pyspark.sql import functions as F


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_sums_of_the_listed_search(spark, depth):
    rng = random.Random(depth)
    edges = spark.createDataFrame([(rng.randint(-20, 20), rng.randint(-20, 20), 0) for _ in range(90)], "src long, dst long, ordinal int")
    starts = spark.createDataFrame([(k % 25, k - 15) for k in range(40)], "root long, node long")
    listed = graph.reach(starts, edges, 10_000, depth).groupBy("root").agg(F.count("*").alias("n"), F.sum("depth").alias("s"), F.sum("node").alias("t"))
    want = {tuple(r) for r in listed.collect()}
    for tile in (7, 1000):
        assert {tuple(r) for r in graph.reach_sums(starts, edges, depth, tile).collect()} == want


def test_reach_of_all_lists_no_second_step(spark):
    """What is saved grows with the edges, not with the pairs two steps apart."""
    hub = spark.createDataFrame([(0, k) for k in range(1, 3001)] + [(k, 0) for k in range(1, 3001)], "src long, dst long")
    got = graph.reach_sums(hub.select(F.col("src").alias("root"), F.col("src").alias("node")).distinct(), hub, 2)
    assert {tuple(r)[1:] for r in got.where("root > 0").collect()} == {(3001, 1 + 2 * 2999, sum(range(3001)))}
    assert [tuple(r) for r in got.where("root = 0").collect()] == [(0, 3001, 3000, sum(range(3001)))]
