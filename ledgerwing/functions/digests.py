"""Digests over ordered rows and framed bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def framed(value: Column) -> Column:
    """A string's UTF-8 bytes after their number as 4 big-endian bytes."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(value)), 8, "0")), value.cast("binary"))


def framed_digest(df: DataFrame, by: list[str], key: str, value: str, name: str = "digest") -> DataFrame:
    """SHA-256 over the framed keys and values of each group, in key order."""
    frame = F.hex(F.concat(framed(F.col(key)), framed(F.col(value))))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"), frame.alias("f"))))
    return df.groupBy(*by).agg(F.sha2(F.unhex(F.array_join(F.transform(ordered, lambda x: x["f"]), "")), 256).alias(name))


def set_digest(col: str | Column, separator: str = "\n") -> Column:
    """Aggregate: SHA-256 of a group's distinct values, sorted and joined."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(col)), separator).cast("binary"), 256)


def part_names(parts: DataFrame, by: list[str], name: str, order: list[str]) -> DataFrame:
    """``parts`` with equal names of a group told apart by ``#n``, from the second on."""
    nth = F.row_number().over(Window.partitionBy(*by, name).orderBy(*order))
    return parts.withColumn("part_name", F.when(nth > 1, F.concat(F.col(name), F.lit("#"), nth.cast("string"))).otherwise(F.col(name)))


def build_fingerprint(parts: DataFrame, by: list[str], version: str, name: str, sha: str, path: str) -> DataFrame:
    """(by, fingerprint): SHA-256 of a version line and a line for each part in (name, path) order."""
    lines = part_names(parts, by, name, [path])
    body = F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(path).alias("p"), F.concat("part_name", F.lit("="), F.col(sha)).alias("l"))))
    text = F.concat(F.lit("versionCode="), F.first(version).cast("string"), F.lit("\n"), F.array_join(F.transform(body, lambda x: x["l"]), "\n"))
    return lines.groupBy(*by).agg(F.sha2(text.cast("binary"), 256).alias("fingerprint"))
