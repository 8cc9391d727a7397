"""Ordered rules as one CASE expression: the first that holds decides."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: Iterable[tuple[Column, str | Column | None]], otherwise: str | Column | None = None) -> Column:
    """The value of the first rule whose condition is true (null counts as false)."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    rules = list(rules)
    if not rules:
        return value(otherwise)
    case = reduce(lambda c, r: c.when(r[0], value(r[1])), rules[1:], F.when(rules[0][0], value(rules[0][1])))
    return case.otherwise(value(otherwise))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def single_or_null(value: str | Column) -> Column:
    """Aggregate: the only distinct non-null value of a group, else null."""
    col = F.col(value) if isinstance(value, str) else value
    return F.when(F.min(col) == F.max(col), F.min(col))


def ordinal(col: Column, order: tuple[str, ...]) -> Column:
    """The place of a label in ``order`` (null for others)."""
    return F.array_position(F.array(*map(F.lit, order)), col).cast("int") - 1


def strongest(cols: list[Column], order: tuple[str, ...]) -> Column:
    """The label furthest along ``order`` among several columns."""
    return F.element_at(F.array(*map(F.lit, order)), F.greatest(*[F.coalesce(ordinal(c, order), F.lit(0)) for c in cols]) + 1)
