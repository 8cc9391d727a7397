"""The corpus pipeline: classify, filter, remove near copies, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's rows
to the shared store and hands them to the next.  All but the last keep the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwing.llm import op4_quality, op6_jaccard_join, op7_quality_rules, op8_packing
from ledgerwing.llm.op3_language_id import held_out
from ledgerwing.stores import saved


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant, fitted on the labels that op4 learns from, doesn't reject.

    A null text is judged as an empty one; rows are judged each for itself, whatever other columns there are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 5, 0)).select("doc_id", "quality")
    model = op4_quality.fit(docs, labels)
    name = next(n for n in ("score", *map("score{}".format, range(len(docs.columns)))) if n not in docs.columns)
    return op4_quality.score(docs, model, name=name).where(F.col(name) >= op4_quality.THRESHOLD).drop(name)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    A null text has no words and goes; null language and source are values of their own; other columns play no part.
    """
    return op7_quality_rules.passing(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked at a Jaccard
    index of 0.8 or more on 5-word shingles.

    Documents without an id or without words all stay; rows of one id with unlike texts are judged each for itself.
    """
    return op6_jaccard_join.one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens; a null or empty text is its end id alone."""
    return op8_packing.pack_words(docs)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_copies", near_copies), ("packing", packing)]

#: The stages' models and groupings aren't expressible in SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
