"""Ranks, limits and ordered events: every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each key in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_n(df: DataFrame, by: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def best_and_margin(df: DataFrame, by: list[str], score: str, ties: list) -> DataFrame:
    """The best-scored row of each key, its margin to the next (the score itself when alone) and the number of rows."""
    w = Window.partitionBy(*by)
    ranked = df.withColumns({
        "_rank": F.row_number().over(w.orderBy(F.desc(score), *ties)),
        "margin": F.col(score) - F.coalesce(F.lead(score).over(w.orderBy(F.desc(score), *ties)), F.lit(0)),
        "n_candidates": F.count("*").over(w),
    })
    return ranked.where("_rank = 1").drop("_rank")


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def on_change(df: DataFrame, by: list[str], order: list, value: str) -> DataFrame:
    """Rows whose value differs from the one before under their key (the first included)."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
    return df.withColumns({"_new": ~F.col(value).eqNullSafe(before) | first}).where("_new").drop("_new")


def once(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return first_per_key(df, key, order)


def within_budget(df: DataFrame, by: list[str], order: list, budget: int) -> DataFrame:
    return top_n(df, by, order, budget, "_n").drop("_n")


def dense_ids(df: DataFrame, by: list[str], value: str, ordinal: str, name: str = "dense_id") -> DataFrame:
    """(by, value, dense_id): ids of values from 0 by first appearance under ``by``."""
    seen = df.groupBy(*by, value).agg(F.min(ordinal).alias("_first"))
    return seen.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy("_first", value)) - 1).drop("_first")


def arg_max(df: DataFrame, order: list) -> DataFrame:
    return df.orderBy(*order).limit(1)


def ordered_list(cols: list[str], order: str, name: str) -> Column:
    """Aggregate: structs of ``cols`` in the order of one of them."""
    entry = F.struct(order, *[c for c in cols if c != order])
    return F.array_sort(F.collect_list(entry)).alias(name)
