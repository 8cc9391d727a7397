"""Comparing two versions of a table by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import first_match


def _both(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join: columns become structs ``before`` and ``after``, null where absent."""
    pack = lambda df, name: df.select(*key, F.struct(*[c for c in df.columns if c not in key]).alias(name))
    return pack(before, "before").join(pack(after, "after"), key, "full")


def _differs(cols: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")) for c in cols], F.lit(False))


def delta(before: DataFrame, after: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """(key, kind, before, after) of rows added, removed or changed in ``cols``."""
    both = _both(before, after, key)
    kind = first_match([(F.col("before").isNull(), "ADDED"), (F.col("after").isNull(), "REMOVED"), (_differs(cols), "CHANGED")])
    return both.withColumn("kind", kind).where("kind IS NOT NULL").select(*key, "kind", "before", "after")


def delta_filter(changes: DataFrame, text: str, cols: list[str]) -> DataFrame:
    """Changes with the text, in any case, in any of the columns of the new side, or of the old where there is no new one."""
    side = [F.coalesce(F.when(F.col("after").isNotNull(), F.col(f"after.{c}")).otherwise(F.col(f"before.{c}")).cast("string"), F.lit("")) for c in cols]
    return changes.where(F.exists(F.array(*side), lambda c: F.lower(c).contains(text.lower())))


def catalog_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, kind) of every key of either version.

    Columns: confidence, value_type, compiled_default, signatures (sorted array of
    getters), static_site (a site in a static initialiser).  Ambiguity of the new side
    comes before differences.
    """
    both = _both(before, after, key)
    left, right = F.size("before.signatures") > 0, F.size("after.signatures") > 0
    kind = first_match([
        (F.col("before").isNull(), "ADDED"),
        (F.col("after").isNull(), "REMOVED"),
        (F.col("after.confidence") == "AMBIGUOUS", "AMBIGUOUS"),
        (_differs(["value_type"]), "TYPE_CHANGED"),
        (_differs(["compiled_default"]), "DEFAULT_CHANGED"),
        (left & ~right & F.col("after.static_site"), "MOVED_TO_REGISTRY"),
        (_differs(["signatures"]), "REMAPPED"),
    ], "PRESERVED")
    return both.select(*key, kind.alias("kind"))


def change_summary(changes: DataFrame, kinds: tuple[str, ...] = ("ADDED", "REMOVED", "CHANGED")) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in kinds])


def editable_changes(before: DataFrame, after: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, kind) by two anti joins and an inner join, null-safe on every column."""
    added = after.join(before, key, "left_anti").select(key, F.lit("ADDED").alias("kind"))
    removed = before.join(after, key, "left_anti").select(key, F.lit("REMOVED").alias("kind"))
    b, a = before.alias("b"), after.alias("a")
    differs = reduce(lambda x, y: x | y, [~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in cols])
    changed = b.join(a, F.col(f"b.{key}") == F.col(f"a.{key}")).where(differs).select(F.col(f"b.{key}").alias(key), F.lit("CHANGED").alias("kind"))
    return added.union(removed).union(changed)


def key_report(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, side) with side one of confirmed, promoted (new), demoted (gone)."""
    marks = before.select(key).distinct().withColumn("b", F.lit(1)).join(after.select(key).distinct().withColumn("a", F.lit(1)), key, "full")
    return marks.select(key, first_match([(F.col("b").isNull(), "promoted"), (F.col("a").isNull(), "demoted")], "confirmed").alias("side"))


def count_report(df: DataFrame, dims: list[str]) -> DataFrame:
    """Counts by each dimension alone, in one pass."""
    names = [F.coalesce(F.col(d).cast("string"), F.lit("")).alias(d) for d in dims]
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), n.alias("value")) for d, n in zip(dims, names, strict=True)])).alias("x"))
    return rows.groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def pair_compatibility(before: DataFrame, after: DataFrame, key: list[str], same: dict[str, str]) -> DataFrame:
    """Counts of shared keys, and of those whose column differs, by output name."""
    b, a = before.alias("b"), after.alias("a")
    joined = b.join(a, [F.col(f"b.{k}") == F.col(f"a.{k}") for k in key])
    return joined.agg(F.count("*").alias("pairs"), *[F.count_if(~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))).alias(n) for n, c in same.items()])
