"""Package archives: entries as rows, limits, and decoding of their tables.

``binaryFile`` lists the archives; a task opens one at a time and yields its
entries in ZIP order.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_ARCHIVE, MAX_ENTRY, MAX_TOTAL, MAX_ENTRIES = 256 << 20, 256 << 20, 512 << 20, 128
ENTRY_SCHEMA = "archive string, ordinal int, name string, size long, sha256 string, content binary, error string"


def entries(spark: SparkSession, path: str, pattern: str = "", nested: str = ".apk") -> DataFrame:
    """``entries_of`` the files below a path; a file beyond ``MAX_ARCHIVE`` isn't read and is a row with ``error``."""
    files = spark.read.format("binaryFile").load(path)
    fits = F.col("length") <= MAX_ARCHIVE
    large = files.where(~fits).select(F.col("path").alias("archive"), F.lit(-1).alias("ordinal"), F.lit("").alias("name"), F.col("length").alias("size"), *[F.lit(None).cast(t).alias(c) for c, t in (("sha256", "string"), ("content", "binary"))], F.lit("archive too large").alias("error"))
    return entries_of(files.where(fits).select("path", "content"), pattern, nested).union(large)


def entries_of(files: DataFrame, pattern: str = "", nested: str = ".apk") -> DataFrame:
    """One row an entry, of (path, content) rows, whose name matches ``pattern``; entries of nested archives
    follow with ``outer!inner`` names.  A broken archive, or an entry or archive beyond its limit, is a row with ``error``."""

    def run(batches):
        import re

        wanted = re.compile(pattern)
        for batch in batches:
            for path_, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer().to_pybytes() if content.is_valid else b""
                rows = list(_walk(path_, data, wanted, nested))
                yield pa.Table.from_pylist(rows, schema=_ARROW).combine_chunks().to_batches()[0] if rows else pa.RecordBatch.from_pylist([], schema=_ARROW)

    return files.select("path", "content").mapInArrow(run, ENTRY_SCHEMA)


_ARROW = pa.schema([("archive", pa.string()), ("ordinal", pa.int32()), ("name", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("content", pa.binary()), ("error", pa.string())])


def _walk(archive: str, data: bytes, wanted, nested: str, prefix: str = "") -> Iterator[dict]:
    blank = {"archive": archive, "ordinal": -1, "name": prefix, "size": None, "sha256": None, "content": None, "error": None}
    try:
        if len(data) > MAX_ARCHIVE:
            yield blank | {"size": len(data), "error": "archive too large"}
            return
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for k, info in enumerate(z.infolist()):
                name = f"{prefix}{info.filename}"
                if info.file_size > MAX_ENTRY:
                    yield blank | {"ordinal": k, "name": name, "error": "entry too large"}
                    continue
                inner = not prefix and info.filename.endswith(nested)
                if not inner and not wanted.search(info.filename):
                    continue
                body = z.read(info)
                if inner:
                    yield from _walk(archive, body, wanted, nested, f"{name}!")
                else:
                    yield blank | {"ordinal": k, "name": name, "size": len(body), "sha256": hashlib.sha256(body).hexdigest(), "content": body}
    except (zipfile.BadZipFile, RuntimeError, OSError) as e:
        yield blank | {"error": type(e).__name__}


def bounded(entries_: DataFrame, total: int = MAX_TOTAL, count: int = MAX_ENTRIES) -> DataFrame:
    """``entries_`` with ``within``: whether an archive's entries up to this one keep to both limits."""
    w = Window.partitionBy("archive").orderBy("name", "ordinal")
    return entries_.withColumn("within", (F.sum("size").over(w) <= total) & (F.row_number().over(w) <= count))


def accepted(entries_: DataFrame, total: int = MAX_TOTAL, count: int = MAX_ENTRIES) -> DataFrame:
    """The entries, without those of archives that break a limit or have a broken entry: such an archive counts as one
    row with ``error``, and none of its entries is used."""
    marked = bounded(entries_, total, count)
    bad = F.first_value(F.when(F.col("error").isNotNull(), F.col("error")).when(~F.col("within"), "limit"), True)
    whole = Window.partitionBy("archive").orderBy("ordinal", "name").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = marked.withColumn("error", bad.over(whole)).withColumn("_n", F.row_number().over(Window.partitionBy("archive").orderBy("ordinal", "name")))
    out = out.where(F.col("error").isNull() | (F.col("_n") == 1))
    blank = {c: F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("ordinal", "name", "size", "sha256", "content")}
    return out.select("archive", *blank.values(), "error")


def split_names(packages: DataFrame, by: list[str], base: Column, order: str) -> DataFrame:
    """``packages`` with ``part``: ``base``, then ``split-<i>`` in the given order."""
    nth = F.row_number().over(Window.partitionBy(*by, base).orderBy(order))
    return packages.withColumn("part", F.when(base, "base").otherwise(F.concat(F.lit("split-"), (nth - 1).cast("string"))))


def resource_paths(entries_: DataFrame) -> DataFrame:
    return entries_.where(F.col("name").startswith("res/")).select("archive", F.col("name").alias("key"), F.lit("RESOURCE_NAME").alias("namespace"))


def manifest_components(components: DataFrame, kind: str, name: str) -> DataFrame:
    """Distinct ``kind/name`` identifiers of manifest components."""
    return components.select(F.concat_ws("/", kind, name).alias("key"), F.lit("MANIFEST_COMPONENT").alias("namespace")).distinct()


# Fixed values of the public resource-table format: chunk types, flags and value types.
STRING_POOL, TABLE, PACKAGE, TYPE, SPEC = 0x0001, 0x0002, 0x0200, 0x0201, 0x0202
UTF8_FLAG, NO_ENTRY = 0x100, 0xFFFFFFFF
VALUE_KINDS = {0x01: "REFERENCE", 0x02: "REFERENCE", 0x03: "STRING", 0x04: "FLOAT", 0x10: "INT", 0x11: "INT", 0x12: "BOOLEAN", 0x1C: "COLOR", 0x1D: "COLOR", 0x1E: "COLOR", 0x1F: "COLOR"}


def _pool(data: bytes, at: int) -> list[str]:
    n, _, flags, start = struct.unpack_from("<IIII", data, at + 8)
    out = []
    for (place,) in struct.iter_unpack("<I", data[at + 28 : at + 28 + 4 * n]):
        p = at + start + place
        if flags & UTF8_FLAG:
            p += 2 if data[p] & 0x80 else 1
            size = data[p]
            if size & 0x80:
                size = (size & 0x7F) << 8 | data[p + 1]
                p += 1
            out.append(data[p + 1 : p + 1 + size].decode("utf-8", "replace"))
        else:
            (size,) = struct.unpack_from("<H", data, p)
            p += 2
            if size & 0x8000:
                size = (size & 0x7FFF) << 16 | struct.unpack_from("<H", data, p)[0]
                p += 2
            out.append(data[p : p + 2 * size].decode("utf-16-le", "replace"))
    return out


def resource_rows(data: bytes) -> Iterator[tuple[str, str, str, bool]]:
    """(type/key, value kind, value, default configuration) of every simple entry of a resource table."""
    if len(data) < 12 or struct.unpack_from("<H", data)[0] != TABLE:
        return
    at, values = struct.unpack_from("<H", data, 2)[0], []
    while at + 8 <= len(data):
        kind, head, size = struct.unpack_from("<HHI", data, at)
        if size < 8 or at + size > len(data):
            return
        if kind == STRING_POOL:
            values = _pool(data, at)
        elif kind == PACKAGE:
            types_at, _, keys_at = struct.unpack_from("<III", data, at + 8 + 4 + 256)
            types, keys = _pool(data, at + types_at), _pool(data, at + keys_at)
            inner = at + head
            while inner + 8 <= at + size:
                k, h, s = struct.unpack_from("<HHI", data, inner)
                if s < 8:
                    break
                if k == TYPE:
                    type_id, n, start = data[inner + 8], *struct.unpack_from("<II", data, inner + 12)
                    config = data[inner + 24 : inner + h]
                    for (place,) in struct.iter_unpack("<I", data[inner + h : inner + h + 4 * n]):
                        p = inner + start + place
                        if place != NO_ENTRY and p + 16 <= len(data):
                            _, flags, key = struct.unpack_from("<HHI", data, p)
                            if not flags & 1:
                                _, _, value_kind, raw = struct.unpack_from("<HBBI", data, p + 8)
                                yield f"{types[type_id - 1]}/{keys[key]}", VALUE_KINDS.get(value_kind, "UNKNOWN"), _value(value_kind, raw, values), not any(config)
                inner += s
        at += size


def _value(kind: int, raw: int, values: list[str]) -> str:
    if kind == 0x03:
        return values[raw] if raw < len(values) else ""
    if kind == 0x04:
        return repr(struct.unpack("<f", struct.pack("<I", raw))[0])
    if kind == 0x12:
        return "true" if raw else "false"
    if kind in (0x10, 0x11):
        return str(struct.unpack("<i", struct.pack("<I", raw))[0])
    return f"0x{raw:08x}"


def resources(tables: DataFrame) -> DataFrame:
    """(archive, key, kind, value, n_configs) of (archive, content): the default configuration's
    value where there is one, else the first."""

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(resource_rows(content or b""))
                cols = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.record_batch([
                    pa.array([archive] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), *(pa.array(cols[k], pa.string()) for k in range(3)), pa.array(cols[3], pa.bool_()),
                ], names=["archive", "nth", "key", "kind", "value", "is_default"])

    rows = tables.select("archive", "content").mapInArrow(run, "archive string, nth int, key string, kind string, value string, is_default boolean")
    first = F.struct((~F.col("is_default")).alias("d"), "nth")
    return rows.groupBy("archive", "key").agg(F.min_by("kind", first).alias("kind"), F.min_by("value", first).alias("value"), F.count("*").alias("n_configs"))
