"""Which builds a catalog keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import first_match
from .ranking import first_per_key


def retained(builds: DataFrame, foreground: Column | str | None, pinned: Column | str | None, limit: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows kept, with ``keep_rank``; candidates have fingerprint, generated_at, origin.

    With a known pin: the pin, the foreground, the latest other installed
    build, the latest other import, up to ``limit`` (the first two always).
    Without: the foreground, then the latest, two at most.
    """
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    rows = first_per_key(builds, [*by, "fingerprint"], [F.desc("generated_at"), "origin"]).withColumns({"_pin": F.coalesce(F.col("fingerprint") == as_col(pinned), F.lit(False)), "_front": F.coalesce(F.col("fingerprint") == as_col(foreground), F.lit(False))})
    group = Window.partitionBy(*by)
    rows = rows.withColumns({"_pinned": F.max("_pin").over(group), "_imported": F.col("origin") == "IMPORTED"})
    class_ = first_match([(F.col("_pin") & F.col("_pinned"), F.lit(0)), (F.col("_front"), F.lit(1)), (~F.col("_pinned"), F.lit(2)), (~F.col("_imported"), F.lit(2))], F.lit(3))
    rows = rows.withColumn("_class", class_)
    nth = F.row_number().over(Window.partitionBy(*by, "_class").orderBy(F.desc("generated_at"), "fingerprint"))
    rows = rows.withColumn("_nth", nth).where(~F.col("_pinned") | (F.col("_nth") == 1))
    rows = rows.withColumn("keep_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_class", "_nth")))
    most = F.when(F.col("_pinned"), F.lit(limit)).otherwise(F.least(F.lit(limit), F.lit(2)))
    return rows.where((F.col("keep_rank") <= most) | (F.col("_class") <= 1)).drop("_pin", "_front", "_pinned", "_imported", "_class", "_nth")
