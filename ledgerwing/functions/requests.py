"""Request tokens, role references and decisions on JSON records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import first_match
from .text import matches

UUID = "[0-9a-fA-F-]{36}"


def request_millis(token: Column, routes: tuple[str, ...] = ()) -> Column:
    """The time of ``v1|millis|uuid`` (with ``|route`` where ``routes`` are given), else null."""
    tail = rf"\|({'|'.join(routes)})" if routes else ""
    pattern = rf"v1\|([0-9]{{1,16}})\|{UUID}{tail}"
    return F.when(matches(token, pattern), F.regexp_extract(token, pattern, 1).try_cast("long"))


def request_route(token: Column, routes: tuple[str, ...]) -> Column:
    pattern = rf"v1\|[0-9]{{1,16}}\|{UUID}\|({'|'.join(routes)})"
    return F.when(matches(token, pattern), F.regexp_extract(token, pattern, 1))


def role_reference(ref: Column) -> Column:
    """Owner, name and descriptor of ``Lowner;->name(params)result``; null if malformed."""
    pattern = r"(?s)(L[^;]+;)->([^(]+)(\(.*\).+)"
    parts = [F.regexp_extract(ref, pattern, k) for k in (1, 2, 3)]
    return F.when(matches(ref, pattern), F.struct(parts[0].alias("owner"), parts[1].alias("name"), parts[2].alias("descriptor")))


def decision_status(record: Column, expected: dict[str, Column]) -> Column:
    """``ACTIVE`` when a JSON record agrees with every expected field, else the first that doesn't."""
    fields = F.from_json(record, "map<string,string>")
    rules = [(~fields[k].eqNullSafe(v.cast("string")), f"{k.upper()}_MISMATCH") for k, v in expected.items()]
    return first_match([(record.isNull(), "ABSENT"), (fields.isNull(), "INVALID"), *rules], "ACTIVE")
