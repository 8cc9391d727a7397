"""Substring search by trigrams: posting lists, intersected, then verified.

A posting is (trigram, column, key) of a lower-cased text column.  Postings are dealt to ranges of trigrams and sorted, so a search
for a text reads the row groups of its trigrams only; a key is a candidate for a column that has all of them, and
the text itself decides.  Texts of under three characters have no trigrams and are searched by a scan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_ignoring_case

WIDTH = 3


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of a text in lower case, none of a shorter one."""
    chars = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    runs = F.transform(F.array(chars), lambda cs: F.transform(cs, lambda c, i: F.concat(c, F.get(cs, i + 1), F.get(cs, i + 2))))[0]
    return F.array_distinct(F.array_compact(runs))


def postings(df: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """(trigram, place, key): place is the column's among ``columns``; null texts have no postings."""
    per = F.array(*[F.struct(F.lit(k).alias("place"), trigrams(F.col(c).cast("string")).alias("t")) for k, c in enumerate(columns)])
    rows = df.select(F.col(key).alias("key"), F.explode(per).alias("p"))
    return rows.select(F.explode("p.t").alias("trigram"), "p.place", "key")


def write_index(df: DataFrame, path: str, key: str, columns: Iterable[str]) -> None:
    rows = postings(df, key, columns)
    rows.repartitionByRange("trigram", "place", "key").sortWithinPartitions("trigram", "place", "key").write.mode("overwrite").parquet(path)


def candidates(index: DataFrame, text: str) -> DataFrame:
    """(key): rows with all trigrams of the text in one column.  The trigrams are a pushed filter of the index."""
    low = text.lower()
    grams = sorted({low[k : k + WIDTH] for k in range(len(low) - WIDTH + 1)})
    some = index.where(F.col("trigram").isin(*grams)).groupBy("place", "key").agg(F.count_distinct("trigram").alias("n"))
    return some.where(F.col("n") == len(grams)).select("key").distinct()


def indexed_search(df: DataFrame, index: DataFrame, key: str, columns: Iterable[str], text: str) -> DataFrame:
    """Rows with the text, in any case, in any of the columns: what a scan gives."""
    holds = [F.coalesce(contains_ignoring_case(F.col(c), text), F.lit(False)) for c in columns]
    hit = F.greatest(*holds) if len(holds) > 1 else holds[0]
    if len(text) >= WIDTH:
        df = df.join(candidates(index, text).withColumnRenamed("key", key), key, "left_semi")
    return df.where(hit)


def search_report(df: DataFrame, index: DataFrame, key: str, columns: Iterable[str], texts: list[str]) -> DataFrame:
    """(text, n_read, n_found): rows that each search looks at, all of them for a short text, and those it gives."""
    one = lambda d, name: d.agg(F.count("*").alias(name))
    parts = []
    for text in texts:
        read = candidates(index, text) if len(text) >= WIDTH else df
        found = one(indexed_search(df, index, key, columns, text), "n_found")
        parts.append(one(read, "n_read").select(F.lit(text).alias("text"), "n_read").join(found.select(F.lit(text).alias("text"), "n_found"), "text"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
