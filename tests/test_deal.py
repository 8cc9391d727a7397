"""Searches deal large steps to more tasks, not to larger ones."""

from ledgerwing import stores
from ledgerwing.operators import graph


def test_partitions_follow_rows(spark):
    """Within ``saved`` shuffles have partitions by the rows; the session's settings stay."""
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before, seen = [spark.conf.get(k, None) for k in keys], []
    df = spark.range(1000).groupBy((stores.F.col("id") % 7).alias("k")).count()

    class Watched(type(df)):
        @property
        def write(self):
            seen.append([spark.conf.get(k, None) for k in keys])
            return super().write

    out = stores.saved(Watched(df._jdf, spark), rows=40 * stores.DEAL)
    assert out.count() == 7 and seen == [["40", stores.PIECE]] and [spark.conf.get(k, None) for k in keys] == before


def test_searches_tell_their_rows(spark, monkeypatch):
    """F14 to F16: every step of a search says how many rows it deals; a kind without a budget takes no place and still is reached."""
    told = []
    monkeypatch.setattr(graph, "saved", lambda df, *a, rows=0, **k: (told.append(rows), stores.saved(df, *a, rows=rows, **k))[1])
    edges = spark.createDataFrame([(0, k, k) for k in range(1, 101)] + [(k, 1000 + k, k) for k in range(1, 101)], "src long, dst long, ordinal long")
    starts = spark.createDataFrame([(0, 0)], "root long, node long")
    kinds = spark.createDataFrame([(k, "a" if k <= 50 else "free") for k in range(1, 101)], "node long, kind string")
    got = graph.targeted_search(starts, edges, kinds, {"a": 3}, 2)
    assert {r["node"] for r in got.collect()} == {0, *range(1, 101), 1001, 1002, 1003} and max(told) >= 200
    told.clear()
    reached = graph.budgeted_search(starts, edges, 1_000_000, 1)
    names = kinds.withColumn("name", graph.F.col("node").cast("string"))
    row = graph.dependencies(reached, names, {"x": graph.F.col("kind") == "a"}).first()
    assert len(row["x"]) == 50 and row["status"] == "FOUND" and max(told) >= 101
    told.clear()
    writes = spark.createDataFrame([(1, "f", None), (2, "g", 0), (0, "h", 2)], "node long, field string, owner long")
    moves = spark.createDataFrame([("f", "z")], "source string, target string")
    got = graph.cache_lineage(graph.reach(starts, edges, 1_000_000, 1), writes, moves, 3, 10)
    assert {(r["source"], r["target"]) for r in got.collect()} == {(None, "f"), (None, "h"), ("f", "z")} and max(told) >= 101
