"""Joins of saved tables that look small: only what was measured as small is sent to all tasks."""

from pyspark.sql import functions as F

from ledgerwing import stores
from ledgerwing.operators import graph, resolve


def test_a_table_that_looks_small_is_not_broadcast(spark):
    """plans start without any broadcast, for the resolve and its distances; the settings are as before after that."""
    look = stores.saved(spark.range(400_000).select(F.col("id").alias("node"), *[F.lit(1).cast("long").alias(f"c{k}") for k in range(3)]).repartition(1, "node"))
    few = stores.saved(spark.range(40).select(F.col("id").alias("node"), F.lit(2).alias("d")))
    before = {k: spark.conf.get(k, None) for k in (stores._BROADCAST, stores._MEASURED)}
    planned = []
    write = type(look.write).parquet

    def seen(self, path, *a, **b):
        planned.append((spark.conf.get(stores._BROADCAST), self._df.join(few, "node")._jdf.queryExecution().executedPlan().toString()))
        return write(self, path, *a, **b)

    type(look.write).parquet = seen
    try:
        assert resolve.saved(look.join(few, "node")).count() == 40 and graph.distances(few, look.selectExpr("node src", "node + 1 dst"), 1).count() == 41
    finally:
        type(look.write).parquet = write
    assert len(planned) == 3 and all(at == "-1" and "BroadcastExchange" not in plan for at, plan in planned)
    assert {k: spark.conf.get(k, None) for k in before} == before
