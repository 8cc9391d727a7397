"""Typed values, preference keys, JSON maps and raw bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import first_match
from .text import matches

#: Editable value types.
TYPES = ("BOOLEAN", "INT", "LONG", "FLOAT", "DOUBLE", "STRING")
INT_RANGE, LONG_RANGE = (-(2**31), 2**31 - 1), (-(2**63), 2**63 - 1)
#: Integer ranges of descriptors narrower than 32 bits.
NARROW = {"()B": (-128, 127), "()S": (-32768, 32767), "()C": (0, 65535)}


def preference_key(key: Column, prefix: str = "override.") -> Column:
    """Prefix and the first 40 hex digits of the key's SHA-256."""
    return F.concat(F.lit(prefix), F.left(F.sha2(key.cast("binary"), 256), F.lit(40)))


def name_key(pref: Column, prefix: str = "override.", name_prefix: str = "name.") -> Column:
    """The name's key of a value's key; null unless it has 40 hex digits."""
    return F.when(managed_key(pref, prefix), F.concat(F.lit(name_prefix), F.substring(pref, len(prefix) + 1, 40)))


def value_key(name: Column, prefix: str = "override.", name_prefix: str = "name.") -> Column:
    return name_key(name, name_prefix, prefix)


def managed_key(col: Column, prefix: str = "override.") -> Column:
    return F.startswith(col, F.lit(prefix)) & matches(F.substr(col, F.lit(len(prefix) + 1)), "[0-9a-f]{40}")


def _whole(text: Column, bounds: tuple[int, int]) -> Column:
    """An integer within bounds, written with digits alone (a sign may lead)."""
    number = text.try_cast("decimal(38,0)")
    return F.when(matches(text, "[+-]?[0-9]{1,30}") & number.between(*[F.lit(str(b)).cast("decimal(38,0)") for b in bounds]), number)


def _real(text: Column, kind: str) -> Column:
    number = text.try_cast(kind)
    return F.when(matches(text, r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[fFdD]?\s*") & ~F.isnan(number) & (F.abs(number) < float("inf")), number)


def validate(kind: Column, text: Column) -> Column:
    """The value as it is stored, or null where ``text`` is no value of ``kind``."""
    return first_match([
        (text.isNull(), None),
        (kind == "BOOLEAN", F.when(text.isin("true", "false"), text)),
        (kind == "INT", _whole(text, INT_RANGE).cast("string")),
        (kind == "LONG", _whole(text, LONG_RANGE).cast("string")),
        (kind == "FLOAT", _real(text, "float").cast("string")),
        (kind == "DOUBLE", _real(text, "double").cast("string")),
        (kind == "STRING", text),
    ])


def serialize(kind: Column, text: Column) -> Column:
    return F.concat(kind, F.lit(":"), text)


def stored_type(raw: Column, types: tuple[str, ...] = TYPES) -> Column:
    """The type of ``TYPE:value``, split at the first colon; null for unknown types."""
    kind = F.substring_index(raw, ":", 1)
    return F.when((F.instr(raw, ":") > 0) & kind.isin(*types), kind)


def stored_value(raw: Column, types: tuple[str, ...] = TYPES) -> Column:
    kind = stored_type(raw, types)
    return F.when(kind.isNotNull(), validate(kind, F.substr(raw, F.length(kind) + 2)))


def fits_descriptor(kind: Column, descriptor: Column, text: Column) -> Column:
    """Whether an INT value fits the narrower integer that a getter returns."""
    number = text.try_cast("long")
    narrow = [(descriptor == d, number.between(*bounds)) for d, bounds in NARROW.items()]
    return F.when(kind != "INT", F.lit(True)).when(number.isNull(), F.lit(False)).otherwise(first_match(narrow, F.lit(True)))


def default_from_bits(raw: Column, kind: Column, source: Column, sources: tuple[str, ...]) -> Column:
    """Raw bits as a decimal FLOAT or DOUBLE for values from ``sources``; others, and bits of no finite number, stay."""
    whole = raw.try_cast("long")
    as_float = F.java_method(F.lit("java.lang.Float"), F.lit("intBitsToFloat"), F.when(whole.between(*INT_RANGE), whole).cast("int"))
    as_double = F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), whole)
    finite = lambda c: F.when(~c.isin("NaN", "Infinity", "-Infinity"), c)
    decoded = first_match([(kind == "FLOAT", finite(as_float)), (kind == "DOUBLE", finite(as_double))])
    return F.when(source.isin(*sources) & whole.isNotNull(), F.coalesce(decoded, raw)).otherwise(raw)


def normalized_default(raw: Column, kind: Column) -> Column:
    """0 and 1 as booleans where the type is one; other editable types pass."""
    boolean = first_match([(raw == "0", "false"), (raw == "1", "true"), (raw.isin("true", "false"), raw)])
    return first_match([(kind == "BOOLEAN", boolean), (kind.isin(*TYPES, "ENUM"), raw)])


def map_of(text: Column) -> Column:
    """A JSON object, or an array of [key, value] pairs, as a map."""
    pairs = F.from_json(text, "array<array<string>>")
    return F.when(F.ltrim(text).startswith("["), F.map_from_entries(F.transform(pairs, lambda p: F.struct(p[0], p[1])))).otherwise(F.from_json(text, "map<string,string>"))


def pairs_of(entries: Column) -> Column:
    """A map as a JSON array of [key, value] pairs in key order."""
    return F.to_json(F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.array(e["key"], e["value"])))


def first_default(candidates: dict[str, Column]) -> Column:
    """(value, source): the first default that is known, in the order of the sources."""
    value = F.coalesce(*[c.cast("string") for c in candidates.values()])
    return F.struct(value.alias("value"), first_match([(c.isNotNull(), name) for name, c in candidates.items()]).alias("source"))


def decoded_rows(df: DataFrame, labels: dict[str, tuple[tuple[str, ...], str]], flags: tuple[str, ...], maps: tuple[str, ...], default: tuple[str, str]) -> DataFrame:
    """Stored rows as they are read: unknown labels become their fallback, 0 and 1 booleans, JSON texts maps,
    and the ``default`` column is normalised for its type column."""
    value, kind = default
    df = df.withColumns({c: F.when(F.col(c).isin(*known), F.col(c)).otherwise(other) for c, (known, other) in labels.items()})
    df = df.withColumns({c: F.col(c).cast("int") == 1 for c in flags} | {c: map_of(F.col(c)) for c in maps})
    return df.withColumn(value, normalized_default(F.col(value), F.col(kind)))
