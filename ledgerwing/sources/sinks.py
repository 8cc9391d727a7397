"""Exports, published profiles, backups and recovery bundles."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codecs import managed_key, preference_key, stored_value
from ..functions.digests import framed_digest
from ..functions.text import csv_line


def csv_lines(df: DataFrame, cols: list[str]) -> DataFrame:
    """(line): an unquoted header, then rows with every field quoted."""
    head = df.sparkSession.createDataFrame([(",".join(cols),)], "line string")
    return head.union(df.select(csv_line(*map(F.col, cols)).alias("line")))


def json_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """(line): a JSON object for each row, null fields left out."""
    return df.select(F.to_json(F.struct(*cols)).alias("line"))


def write_csv(df: DataFrame, path: str, cols: list[str], order: list) -> None:
    """Ordered CSV part files with all values quoted; the header is a file of its own that sorts first.

    Rows are dealt to ordered ranges, so no task holds all.
    """
    head = df.sparkSession.createDataFrame([(",".join(cols),)], "line string")
    head.coalesce(1).write.mode("overwrite").text(f"{path}/part=0-header")
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(csv_line(*map(F.col, cols)).alias("line")).write.mode("overwrite").text(f"{path}/part=1-rows")


def write_json_lines(df: DataFrame, path: str, cols: list[str], order: list) -> None:
    json_rows(df.repartitionByRange(*order).sortWithinPartitions(*order), cols).write.mode("overwrite").text(path)


def scoped(df: DataFrame, scope: str, modified: DataFrame | None = None, key: str = "key") -> DataFrame:
    """ALL rows, EDITABLE ones, or those MODIFIED by an override."""
    if scope == "EDITABLE":
        return df.where("editable")
    if scope == "MODIFIED":
        return df.join(modified.select(key), key, "left_semi")
    return df


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def export_unchanged(spark: SparkSession, path: str, build: Callable[[], str], write: Callable[[str], None]) -> None:
    """``write`` an export beside ``path`` and move it there, unless the build changed meanwhile; what was written
    then, or before an error, is deleted, and nothing is at ``path``."""
    before, part = build(), f"{path}-{uuid.uuid4().hex}"
    fs, place = _fs(spark, part)
    try:
        write(part)
        if build() != before:
            raise RuntimeError("the build changed during the export")
        if not fs.rename(place, _fs(spark, path)[1]):
            raise RuntimeError(f"{path} can't be written")
    finally:
        fs.delete(place, True)


def inventory_documents(identifiers: DataFrame, by: list[str], cols: list[str], header: dict[str, Column], method: str) -> DataFrame:
    """(by, document): one JSON document a build, where getters are places in a table of distinct methods.

    identifiers: (by, key, cols, getters), getters an array of structs with the field ``method`` that tells them apart. Methods
    are numbered in order of their first use (by key, then place).
    """
    uses = identifiers.select(*by, "key", F.posexplode("getters").alias("_at", "_m"))
    ids = uses.groupBy(*by, F.col(f"_m.{method}").alias("_id")).agg(F.min(F.struct("key", "_at", "_m")).alias("_first"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("_first.key", "_first._at", "_id")) - 1
    ids = ids.withColumn("_n", nth)
    methods = ids.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col("_first._m").alias("m")))), lambda x: x["m"]).alias("methods"))
    places = uses.withColumn("_id", F.col(f"_m.{method}")).join(ids.select(*by, "_id", "_n"), [*by, "_id"])
    lists = places.groupBy(*by, "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_n"))), lambda x: x["_n"]).alias("getters"))
    rows = identifiers.drop("getters").join(lists, [*by, "key"], "left").withColumn("getters", F.coalesce("getters", F.array().cast("array<int>")))
    body = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("key", *cols, "getters"))).alias("identifiers"))
    full = body.join(methods, by, "left").withColumn("methods", F.coalesce("methods", F.array().cast(methods.schema["methods"].dataType)))
    return full.select(*by, F.to_json(F.struct(*[v.alias(k) for k, v in header.items()], "methods", "identifiers")).alias("document"))


def compact_rows(inventory: DataFrame, by: list[str]) -> DataFrame:
    """(by, line): a JSON object for each editable identifier of parsed inventories (by, methods, identifiers), its getters
    looked up in the table of methods."""
    rows = inventory.select(*by, "methods", F.explode("identifiers").alias("i")).where("i.editable")
    getters = F.transform("i.getters", lambda k: F.get("methods", k))
    names = ["key", "namespace", "value_type", "compiled_default", "confidence"]
    return rows.select(*by, F.to_json(F.struct(*[F.col(f"i.{c}").alias(c) for c in names], getters.alias("getters"))).alias("line"))


BACKUP = "struct<schemaVersion:int,buildFingerprintSha256:string,overrides:map<string,string>,suspended:map<string,struct<raw:string,identifier:string>>>"


def backup_documents(overrides: DataFrame, by: list[str], build: str, version: int = 3) -> DataFrame:
    """(by, document): active overrides by key and suspended ones by preference key; of
    (by, build, key, preference_key, raw, reason).  A suspended override without a value isn't backed up."""
    some = lambda cond, entry: F.map_from_entries(F.array_sort(F.collect_list(F.when(cond, entry))))
    active = F.col("reason").isNull() & F.col("key").isNotNull() & F.col("raw").isNotNull()
    held = F.col("reason").isNotNull() & F.col("raw").isNotNull()
    out = overrides.groupBy(*by, build).agg(some(active, F.struct("key", "raw")).alias("overrides"), some(held, F.struct("preference_key", F.struct("raw", F.col("key").alias("identifier")))).alias("suspended"))
    return out.select(*by, F.to_json(F.struct(F.lit(version).alias("schemaVersion"), F.col(build).alias("buildFingerprintSha256"), "overrides", "suspended")).alias("document"))


def import_backup(documents: DataFrame, by: list[str], build: Column, reasons: Callable[[DataFrame], DataFrame], versions: tuple[int, int] = (2, 3), prefix: str = "override.") -> DataFrame:
    """(by, preference_key, name, raw, verdict) of what a backup asks for.

    ``reasons`` adds ``reason`` to rows (by, key, preference_key, raw).  ACCEPTED: an active override without a reason; REJECTED:
    with one; RESTORED: a suspended one whose value can be read and whose place no accepted one takes.
    A document of another version or build gives one row with verdict WRONG_DOCUMENT.
    """
    read = documents.select(*by, build.alias("_build"), F.from_json("document", BACKUP).alias("d"))
    fits = F.coalesce(F.col("d.schemaVersion").between(*versions) & (F.lower("d.buildFingerprintSha256") == F.lower("_build")), F.lit(False))
    wrong = read.where(~fits).select(*by, *[F.lit(None).cast("string").alias(c) for c in ("preference_key", "name", "raw")], F.lit("WRONG_DOCUMENT").alias("verdict"))
    good = read.where(fits)
    asked = good.select(*by, F.explode("d.overrides").alias("key", "raw")).withColumn("preference_key", preference_key(F.col("key"), prefix))
    judged = reasons(asked).select(*by, "preference_key", F.col("key").alias("name"), "raw", F.when(F.col("reason").isNull(), "ACCEPTED").otherwise("REJECTED").alias("verdict"))
    held = good.select(*by, F.explode("d.suspended").alias("preference_key", "s")).where(F.col("preference_key").startswith(prefix) & stored_value(F.col("s.raw")).isNotNull())
    own = F.when(preference_key(F.col("s.identifier"), prefix) == F.col("preference_key"), F.col("s.identifier"))
    free = held.join(judged.where("verdict = 'ACCEPTED'").select(*by, "preference_key"), [*by, "preference_key"], "left_anti")
    return wrong.union(judged).union(free.select(*by, "preference_key", own.alias("name"), "s.raw", F.lit("RESTORED").alias("verdict")))


def publish(df: DataFrame, root: str, valid: Callable[[DataFrame], bool]) -> str:
    """Write the slot that isn't current, read it back, and only then point to it.

    Readers follow the pointer, so they see the old rows or the new ones whole.
    """
    spark = df.sparkSession
    slot = "b" if current_slot(spark, root) == "a" else "a"
    target = f"{root}/{slot}"
    df.write.mode("overwrite").parquet(target)
    if not valid(spark.read.parquet(target)):
        raise ValueError("the written rows don't pass validation")
    pointer = spark.createDataFrame([(json.dumps({"slot": slot, "token": uuid.uuid4().hex}),)], "value string")
    pointer.coalesce(1).write.mode("overwrite").text(f"{root}/pointer-{slot}")
    fs, old = _fs(spark, f"{root}/pointer-{'a' if slot == 'b' else 'b'}")
    fs.delete(old, True)
    return slot


def current_slot(spark: SparkSession, root: str) -> str | None:
    for slot in ("a", "b"):
        fs, place = _fs(spark, f"{root}/pointer-{slot}/_SUCCESS")
        if fs.exists(place):
            return slot
    return None


def published(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{current_slot(spark, root)}")


def profile_json(mappings: DataFrame, header: dict[str, Column], by: list[str], cols: list[str], order: str) -> DataFrame:
    """(by, profile): one JSON document a group, its mappings in order."""
    body = F.array_sort(F.collect_list(F.struct(order, *[c for c in cols if c != order])))
    grouped = mappings.groupBy(*by).agg(body.alias("mappings"))
    return grouped.select(*by, F.to_json(F.struct(*[v.alias(k) for k, v in header.items()], "mappings")).alias("profile"))


def bundle(entries: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """(by, entries, sha256): a recovery bundle with its framed digest."""
    entries = entries.where(F.col(key).isNotNull())
    maps = entries.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("entries"))
    return maps.join(framed_digest(entries, by, key, value, "sha256"), by)


def bundle_errors(bundles: DataFrame, by: list[str], prefixes: tuple[str, ...]) -> DataFrame:
    """(by, error) of bundles whose checksum differs or that hold unmanaged keys."""
    rows = bundles.select(*by, "sha256", F.explode("entries").alias("_k", "_v"))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    actual = framed_digest(rows, by, "_k", "_v", "_sha")
    bad = rows.groupBy(*by).agg(F.count_if(~F.greatest(*[managed_key(F.col("_k"), p) for p in prefixes]) if len(prefixes) > 1 else ~managed_key(F.col("_k"), prefixes[0])).alias("_bad"))
    joined = bundles.select(*by, "sha256").join(actual, by, "left").join(bad, by, "left")
    error = F.when(~F.col("sha256").eqNullSafe(F.coalesce("_sha", nothing)), "CHECKSUM").when(F.col("_bad") > 0, "UNMANAGED_KEY")
    return joined.withColumn("error", error).where("error IS NOT NULL").select(*by, "error")


def ownership_errors(entries: DataFrame, records: DataFrame, by: list[str], current: Column, errors: dict[str, str], prefix: str = "override.") -> DataFrame:
    """(by, key, error): records of a bundle that contend with a normal override for the same key.

    entries: (by, k), a bundle's preference keys; records: (by, kind, key, active, build, handoff).  Only an active record of the ``current``
    build that wasn't handed over contends; paused and historical ones may stand beside a normal value.  errors: by kind.
    """
    live = records.where(F.col("active") & (F.lower("build") == F.lower(current)) & F.col("handoff").isNull())
    clash = live.withColumn("k", preference_key(F.col("key"), prefix)).join(entries.select(*by, "k").distinct(), [*by, "k"], "left_semi")
    error = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(name)) for kind, name in errors.items()])
    return clash.select(*by, "key", error.alias("error")).where("error IS NOT NULL")
