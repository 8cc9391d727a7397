"""Large tiles: what is dealt to tasks grows little beyond the edges themselves, and sums don't depend on the nodes' numbers."""

import pytest
from pyspark.sql import functions as F

from ledgerwing.operators import graph


@pytest.mark.parametrize("step", [1, 2, 10**9 + 7, -(2**40)])
def test_sums_of_any_numbers(spark, step):
    """Near numbers, even ones, and those beyond 32 bits or far apart."""
    pairs = {(k % 37, (k * k + k // 3) % 41) for k in range(300)}
    near = {}
    for a, b in pairs:
        near.setdefault(a * step, set()).add(b * step)
    want = {}
    for r in near:
        one = near[r] | {r}
        two = set().union(one, *(near.get(n, set()) for n in one))
        want[r] = (len(two), len(one) - 1 + 2 * len(two - one), sum(two))
    edges = spark.createDataFrame([(a * step, b * step) for a, b in pairs], "src long, dst long")
    for tile in (20, 10_000):
        got = graph.reach_sums(edges.select(F.col("src").alias("root"), F.col("src").alias("node")).distinct(), edges, 2, tile)
        assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def test_tiles_are_large(spark):
    """with tiles of 4 million, 432 million edges were dealt to 108 tasks each; a billion edges are dealt some 32 times now."""
    assert -(-1_000_000_000 // graph.TILE) <= 32
