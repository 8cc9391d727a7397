"""The versioned catalog: builds, identifiers and their children as DataFrames.

Tables: builds(base_sha, generated_at, origin, ...), identifiers(base_sha, key, ...), getters
and consumers(base_sha, key, ordinal, ...).  Stored partitioned by ``base_sha``, so
a lookup of a build prunes to its partition.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codecs import preference_key
from ..functions.rules import all_of
from ..functions.text import contains_ignoring_case
from ..stores import saved
from .ranking import arg_max, ordered_list, page


@dataclass(frozen=True)
class CatalogQuery:
    """Optional conditions of a search; all given ones must hold.

    ``keys`` empty (not None) selects nothing.  Text is taken literally in
    every text column.
    """

    text: str = ""
    text_columns: tuple[str, ...] = ("key", "kind", "value_type", "resolution")
    equals: dict[str, object] = field(default_factory=dict)
    flags: dict[str, bool] = field(default_factory=dict)
    contains: dict[str, str] = field(default_factory=dict)
    keys: tuple | None = None
    key_column: str = "key"

    def condition(self) -> Column:
        parts = [F.col(c) == v for c, v in self.equals.items()]
        parts += [F.col(c) if on else ~F.col(c) for c, on in self.flags.items()]
        parts += [contains_ignoring_case(F.col(c), t) for c, t in self.contains.items()]
        if self.text:
            hits = [contains_ignoring_case(F.col(c), self.text) for c in self.text_columns]
            parts.append(F.coalesce(F.greatest(*[F.coalesce(h, F.lit(False)) for h in hits]) if len(hits) > 1 else hits[0], F.lit(False)))
        if self.keys is not None:
            parts.append(F.col(self.key_column).isin(*self.keys) if self.keys else F.lit(False))
        return all_of(parts)


def search(df: DataFrame, query: CatalogQuery) -> DataFrame:
    return df.where(query.condition())


def search_page(df: DataFrame, query: CatalogQuery, order: list, limit: int, offset: int = 0) -> DataFrame:
    return page(search(df, query), order, limit, offset)


def search_count(df: DataFrame, query: CatalogQuery) -> DataFrame:
    return search(df, query).agg(F.count("*").alias("total"))


def list_filter(df: DataFrame, text: str, cols: Iterable[str]) -> DataFrame:
    """Rows with the text, in any case, in any of the columns."""
    return df.where(F.exists(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), lambda c: F.lower(c).contains(text.lower())))


def attach(parents: DataFrame, children: DataFrame, key: list[str], order: str, cols: list[str], name: str) -> DataFrame:
    """Each parent with its children as one ordered array (empty where it has none)."""
    lists = children.join(parents.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(ordered_list(cols, order, name))
    joined = parents.join(lists, key, "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(joined.schema[name].dataType)))


def existing_keys(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return df.select(key).join(wanted.select(key), key, "left_semi").distinct().orderBy(key)


def singletons(parents: DataFrame, children: DataFrame, key: str, condition: Column, limit: int) -> DataFrame:
    """Keys of parents under ``condition`` that have exactly one child."""
    counted = parents.where(condition).join(children.select(key), key).groupBy(key).agg(F.count("*").alias("n"))
    return counted.where("n = 1").select(key).orderBy(key).limit(limit)


def summary(builds: DataFrame, build: str) -> DataFrame:
    """One build; a blank hash reads as its fingerprint."""
    sha = F.coalesce(F.nullif(F.trim("base_apk_sha"), F.lit("")), "base_sha")
    return builds.where(F.col("base_sha") == build).withColumn("base_apk_sha", sha)


def previous_build(builds: DataFrame, build: str | None = None) -> DataFrame:
    """The latest build, other than ``build`` and not imported where that is given."""
    rest = builds if build is None else builds.where((F.col("base_sha") != build) & (F.col("origin") != "IMPORTED"))
    return arg_max(rest, [F.desc("generated_at"), "base_sha"])


def baseline(builds: DataFrame, identifiers: DataFrame, getters: DataFrame, build: str) -> DataFrame:
    """Editable identifiers, with getters only, of the build itself or else its predecessor."""
    own = builds.where(F.col("base_sha") == build).select("base_sha", F.lit(0).alias("place"))
    other = previous_build(builds, build).select("base_sha", F.lit(1).alias("place"))
    chosen = arg_max(own.union(other), ["place"]).select("base_sha")
    rows = identifiers.where("editable").join(F.broadcast(chosen), "base_sha", "left_semi")
    return attach(rows, getters, ["base_sha", "key"], "ordinal", [c for c in getters.columns if c not in ("base_sha", "key")], "getters")


def run_summary(df: DataFrame, metadata: str, counts: dict[str, tuple[str, str] | list[tuple[str, str]]]) -> DataFrame:
    """One row of counts: of rows whose metadata has a value, by output name; of a list of
    (key, value) pairs the counts are added, so a row that has two counts twice."""
    has = lambda k, v: F.count_if(F.coalesce(F.element_at(metadata, k) == v, F.lit(False)))
    sums = {name: pairs if isinstance(pairs, list) else [pairs] for name, pairs in counts.items()}
    return df.agg(F.count("*").alias("total"), *[reduce(lambda a, b: a + b, [has(*p) for p in pairs]).alias(name) for name, pairs in sums.items()])


@dataclass(frozen=True)
class RetryRule:
    """Names and values, in a metadata map, of what says that a key's search came to no end and is due again."""

    exhausted: tuple[str, str] = ("budgetExhausted", "true")
    attempted: str = "attempted"
    strategy: tuple[str, str] = ("strategy", "current")
    reason: tuple[str, tuple[str, ...]] = ("reason", ())
    limitation: tuple[str, str] = ("limitation", "UNKNOWN")
    metadata: str = "metadata"

    def _is(self, key: str, *values: str) -> Column:
        return F.coalesce(F.element_at(self.metadata, key).isin(*values), F.lit(False))

    def inconclusive(self, editable: Column) -> Column:
        """Editable, out of budget and not tried again."""
        return editable & self._is(*self.exhausted) & F.element_at(self.metadata, self.attempted).isNull()

    def retry(self) -> Column:
        """Not by the present strategy, and out of budget for a reason that may pass, or of unknown limitation."""
        again = self._is(*self.exhausted) & self._is(self.reason[0], *self.reason[1])
        return ~self._is(*self.strategy) & (again | self._is(*self.limitation))


def ordered_keys(df: DataFrame, condition: Column, key: str, limit: int) -> DataFrame:
    """The first ``limit`` keys under a condition, in order."""
    return page(df.where(condition).select(key), [key], limit)


def actionable_count(df: DataFrame, *conditions: Column) -> DataFrame:
    """The sum of the conditions' counts: a row under two of them counts twice."""
    return df.agg(reduce(lambda a, b: a + b, [F.count_if(F.coalesce(c, F.lit(False))) for c in conditions]).alias("actionable"))


def pending_keys(df: DataFrame, inconclusive: Column, retry: Column, key: str) -> DataFrame:
    """Distinct keys that are inconclusive or due for another try."""
    return df.where(inconclusive).select(key).union(df.where(retry).select(key)).distinct()


def merge_results(target: DataFrame, updates: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """``target`` with ``cols`` of matching updates; updates of unknown keys are skipped."""
    new = updates.select(*key, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_hit"))
    joined = target.join(new, key, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in target.columns])


def replace_children(children: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """Children with those of updated keys replaced."""
    return children.join(updates.select(*key).distinct(), key, "left_anti").unionByName(updates)


def key_slice(df: DataFrame, order: list, start: int, size: int) -> DataFrame:
    """Rows ``start`` to ``start + size`` in order."""
    return page(df, order, size, start)


def latest_names(identifiers: DataFrame, builds: DataFrame, by: str = "preference_key") -> DataFrame:
    """The key each preference had in its most recent build."""
    dated = identifiers.join(builds.select("base_sha", "generated_at"), "base_sha")
    last = Window.partitionBy(by).orderBy(F.desc("generated_at"), "key", "base_sha")
    return dated.withColumn("_n", F.row_number().over(last)).where("_n = 1").select(by, "key", "base_sha")


def union_distinct(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """All sources, each key from the first source that has it."""
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    rest = [c for c in sources[0].columns if c not in key]
    first = Window.partitionBy(*key).orderBy("_source", *[F.to_json(F.struct(*rest)) if rest else F.lit(1)])
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_source")


def union_unlike(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of lists of unlike shape as one list, missing columns null; of equal keys the row of the earliest list stays, and of
    one list's the first by its own values."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("_source", F.lit(k)) for k, s in enumerate(sources)])
    rest = [c for c in both.columns if c not in (*key, "_source")]
    first = Window.partitionBy(*key).orderBy("_source", *([F.to_json(F.struct(*rest))] if rest else []))
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_source")


#: The stored tables; children have their parent's key and a place among its children.
BUILDS = "base_sha string, generated_at long, dex_hashes map<string,string>, identifier_count int, editable_count int, error_count int, resolver_schema int, base_apk_sha string, version_code long, package_artifacts map<string,string>, origin string"
IDENTIFIERS = "base_sha string, key string, namespace string, value_type string, compiled_default string, confidence string, reason string, editable boolean, preference_key string, occurrence_count int, kind string, resolution string, runtime_status string, semantics_reviewed boolean, editability_reason string, metadata map<string,string>, storage_type string, semantic_type string, evidence_confidence string, semantics_provenance string"
GETTERS = "base_sha string, key string, ordinal int, dex string, class_name string, method_name string, descriptor string, return_type string, parameter_types array<string>, instruction_count int, opcode_sha string, is_clinit boolean, referenced_fields array<string>, invoked_methods array<string>"
CONSUMERS = f"{GETTERS}, depth int, link_kind string, path array<string>, semantic_summary string"


def put(rows: DataFrame, path: str, order: tuple[str, ...] = ("key",)) -> None:
    """Replace the builds that ``rows`` holds; other builds' partitions stay.  Rows lie in ``order`` within
    files, so a lookup by key skips most row groups."""
    dealt = rows.repartitionByRange("base_sha", *order).sortWithinPartitions("base_sha", *order)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("base_sha").parquet(path)


def children_of(parents: DataFrame, key: list[str], lists: str) -> DataFrame:
    """(key, ordinal, fields): a row for each struct of the array column ``lists``, with its place from 0."""
    return parents.select(*key, F.posexplode(lists).alias("ordinal", "_child")).select(*key, "ordinal", "_child.*")


def compact(rows: DataFrame, heavy: tuple[str, ...]) -> DataFrame:
    """The same columns with heavy ones null, so that a scan doesn't read them."""
    return rows.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name in heavy else F.col(f.name) for f in rows.schema])


def by_preference(rows: DataFrame, wanted: DataFrame, key: str = "key", column: str = "preference_key") -> DataFrame:
    """Identifiers whose hashed key is wanted: the hash is made from the key, not stored."""
    return rows.withColumn(column, preference_key(F.col(key))).join(wanted.select(column).distinct(), column, "left_semi")


def export_pages(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """``df`` with ``page``, the number of each row's page in order; ranges of rows are numbered apart and then shifted, so
    no task holds all."""
    dealt = saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    numbered = dealt.withColumn("_nth", nth).join(F.broadcast(starts.select("_part", "_start")), "_part")
    return numbered.withColumn("page", F.floor((F.col("_start") + F.col("_nth")) / size)).drop("_part", "_nth", "_start")


def pin(builds: DataFrame, build: str) -> DataFrame:
    """``builds`` with one marked installed; an error where it is missing."""
    known = builds.where(F.col("base_sha") == build).limit(1).count()
    if not known:
        raise ValueError(f"no build {build}")
    return builds.withColumn("origin", F.when(F.col("base_sha") == build, "INSTALLED").otherwise(F.col("origin")))


def imported_origin(origin: Column, sha: Column, pinned: str | None) -> Column:
    """An import never relabels the pinned build."""
    return F.when((origin == "IMPORTED") & sha.eqNullSafe(F.lit(pinned)), "INSTALLED").otherwise(origin)


def prune(table: DataFrame, kept: DataFrame) -> DataFrame:
    return table.join(kept.select("base_sha"), "base_sha", "left_semi")


#: Columns that later versions added, with the value that older rows read as.
ADDED = {"kind": "UNKNOWN", "resolution": "UNSUPPORTED", "runtime_status": "NOT_ANALYZED", "semantics_reviewed": False, "metadata": "[]", "storage_type": "UNKNOWN", "semantic_type": "UNKNOWN", "semantics_provenance": ""}


def upgraded(df: DataFrame, added: dict[str, object] = ADDED) -> DataFrame:
    """Rows of an older version with the added columns at their defaults."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in added.items()})


def load(spark: SparkSession, path: str, build: str | None = None) -> DataFrame:
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df if build is None else df.where(F.col("base_sha") == build)
