"""Text expressions: quoting, escaping, names and shapes of members."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import any_of

def like_escape(text: str) -> str:
    """Escape a search text so that LIKE takes it literally."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ignoring_case(col: Column, text: str) -> Column:
    return col.ilike(f"%{like_escape(text)}%")


def matches(col: Column, pattern: str) -> Column:
    """Whether the pattern fits the whole text, a line break at its end included."""
    return col.rlike(rf"\A(?:{pattern})\z")


def csv_field(col: Column) -> Column:
    """A field in quotes, inner quotes doubled; null is an empty field."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(col.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line(*cols: Column) -> Column:
    return F.concat_ws(",", *map(csv_field, cols))


def dotted_class(col: Column) -> Column:
    """``Lcom/acme/Name;`` as ``com.acme.Name``; other names unchanged."""
    return F.when(matches(col, "(?s)L.*;"), F.translate(F.substr(col, F.lit(2), F.length(col) - 2), "/", ".")).otherwise(col)


def field_shape(col: Column) -> Column:
    """The type of ``owner->name:type``."""
    return F.when(F.instr(col, ":") > 0, F.substring_index(col, ":", -1)).otherwise(col)


def call_shape(col: Column) -> Column:
    """Parameters and result of ``owner->name(params)result``; empty without parameters."""
    return F.when(F.instr(col, "(") > 0, F.substr(col, F.instr(col, "("))).otherwise("")


def method_shape(returns: Column, parameters: Column, static: Column) -> Column:
    """What a method looks like without its names: ``static (params)result``."""
    return F.concat(F.when(static, "static ").otherwise(""), F.lit("("), F.array_join(parameters, ""), F.lit(")"), returns)


def stable_owner(col: Column, stable: tuple[str, ...]) -> Column:
    """The owner of a member if its package isn't renamed between builds (one of the prefixes in ``stable``), else null."""
    name = owner(col)
    return F.when(any_of([name.startswith(p) for p in stable]), name)


def owner(col: Column) -> Column:
    return F.substring_index(col, "->", 1)


def signature(class_name: Column, method: Column, descriptor: Column) -> Column:
    return F.concat(class_name, F.lit("->"), method, descriptor)


#: Fixed value: where names are cut into words.
WORD_CUTS = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[^A-Za-z0-9]+"


def words_of(col: Column) -> Column:
    """Lower-case words of a name, cut at ``WORD_CUTS``."""
    return F.transform(F.filter(F.split(col, WORD_CUTS), lambda w: w != ""), F.lower)
