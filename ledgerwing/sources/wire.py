"""Schema-free decoding of protobuf wire bytes into flat rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import base64_payload, config_like

MAX_BYTES, MAX_FIELDS, MAX_DEPTH = 1 << 20, 4096, 8
SCHEMA = "path string, depth int, number int, wire_type string, value string, size int"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while shift < 70:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            if value >> 64:
                break
            return value, at
        shift += 7
    raise ValueError("varint")


def _printable(data: bytes) -> str | None:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if all(c.isprintable() or c in "\t\n\r" for c in text) else None


def fields(data: bytes, depth: int = 0, path: str = "", left: list[int] | None = None) -> Iterator[tuple]:
    """Rows of one message; ValueError where the bytes are none."""
    left = [MAX_FIELDS] if left is None else left
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        left[0] -= 1
        if not 0 < number < 1 << 29 or left[0] < 0:
            raise ValueError("field")
        here = f"{path}/{number}" if path else str(number)
        if wire == 0:
            value, at = _varint(data, at)
            yield here, depth, number, "VARINT", str(value), None
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            if at + size > len(data):
                raise ValueError("truncated")
            yield here, depth, number, f"FIXED{8 * size}", str(int.from_bytes(data[at : at + size], "little")), size
            at += size
        elif wire == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("truncated")
            body, at = data[at : at + size], at + size
            text = _printable(body)
            nested = None
            if text is None and depth + 1 < MAX_DEPTH:
                try:
                    nested = list(fields(body, depth + 1, here, left))
                except (ValueError, IndexError):
                    nested = None
            yield here, depth, number, "LENGTH_DELIMITED", text, size
            yield from nested or ()
        else:
            raise ValueError("group")


def decode(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, SCHEMA) rows of each payload.  An empty or null one gives none; one that is no message, or beyond a
    limit, gives one row at depth -1 with wire type INVALID or TOO_LARGE and its size."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys, rows = [], []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not data:
                    continue
                try:
                    got = list(fields(data)) if len(data) <= MAX_BYTES else [("", -1, None, "TOO_LARGE", None, len(data))]
                except (ValueError, IndexError):
                    got = [("", -1, None, "INVALID", None, len(data))]
                rows += got
                keys += [k] * len(got)
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32()]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.record_batch([pa.array(keys, batch.schema.field(0).type), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[key, *(x.split()[0] for x in SCHEMA.split(", "))])

    return df.select(key, payload).mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")


def repeated_fields(rows: DataFrame, key: str) -> DataFrame:
    """(key, path, n) of fields that occur more than once."""
    return rows.where("depth >= 0").groupBy(key, "path").agg(F.count("*").alias("n")).where("n > 1")


def schema_errors(rows: DataFrame, schema: DataFrame, key: str, unknown: bool = True) -> DataFrame:
    """(key, number, error) of top-level fields against (number, wire_type, repeated); ``unknown``: whether
    a field outside the schema is an error."""
    top = rows.where("depth = 0").groupBy(key, "number").agg(F.count("*").alias("n"), F.collect_set("wire_type").alias("types"))
    known = schema.select("number", F.col("wire_type").alias("want"), "repeated")
    error = F.when(F.col("want").isNull() & F.lit(unknown), "UNKNOWN_FIELD").when(F.col("want").isNull(), None).when(~F.array_contains("types", F.col("want")) | (F.size("types") > 1), "WIRE_TYPE").when(~F.col("repeated") & (F.col("n") > 1), "REPEATED")
    return top.join(known, "number", "left").withColumn("error", error).where("error IS NOT NULL").select(key, "number", "error")


def enriched(df: DataFrame, key: str, name: str, kind: str, value: str, words: tuple[str, ...]) -> DataFrame:
    """``df`` with ``n_fields`` of values that are messages; those can't be edited as text.

    Only STRING and BYTES values are looked into, and only under names with one of ``words``.
    """
    maybe = F.col(kind).isin("STRING", "BYTES") & config_like(F.col(name), words)
    payloads = df.where(maybe).select(key, base64_payload(F.col(value)).alias("_payload")).where("_payload IS NOT NULL")
    found = decode(payloads, key, "_payload").groupBy(key).agg(F.count_if(F.col("depth") >= 0).cast("int").alias("n_fields"))
    out = df.join(found.where("n_fields > 0"), key, "left")
    return out.withColumn("editable", F.col("editable") & F.col("n_fields").isNull())
