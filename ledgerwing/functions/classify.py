"""Classification by tables of rules: the rules are the caller's data, this module only evaluates them.

A ``Rule`` gives its label where all its tests hold; ``classify`` takes the first rule of a table that does.
Namespaces, kinds, roles, types, method categories, risks and reasons are all such tables; the
queries register invented ones.  Everything becomes one CASE expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import all_of, any_of, first_match, ordinal, strongest
from .text import matches, words_of

#: Strengths of evidence, weakest first.
STRENGTHS = ("NONE", "LOW", "MEDIUM", "HIGH", "PROVEN")


def _each(values, test: Callable[[object], Column]) -> Column:
    return any_of([test(v) for v in ((values,) if isinstance(values, str) else values)])


#: What a test can ask of a text column; any of the given values suffices.
TESTS: dict[str, Callable[[Column, object], Column]] = {
    "is_": lambda c, v: c.isin(*((v,) if isinstance(v, str) else v)),
    "starts": lambda c, v: _each(v, c.startswith),
    "ends": lambda c, v: _each(v, c.endswith),
    "has": lambda c, v: _each(v, c.contains),
    "has_folded": lambda c, v: _each(v, lambda x: F.lower(c).contains(x.lower())),
    "shape": lambda c, v: _each(v, lambda p: matches(c, p)),
    "word": lambda c, v: F.arrays_overlap(words_of(c), F.array(*map(F.lit, (v,) if isinstance(v, str) else v))),
    "at_most": lambda c, v: c <= F.lit(v),
    "true": lambda c, v: c if v else ~c,
    "null": lambda c, v: c.isNull() if v else c.isNotNull(),
}


@dataclass(frozen=True)
class Test:
    """One test of a column; of an array column some item has to pass, or with ``every`` each of at least one."""

    column: str
    ask: str
    value: object
    array: bool = False
    every: bool = False
    negated: bool = False

    def holds(self) -> Column:
        test = lambda c: F.coalesce(TESTS[self.ask](c, self.value), F.lit(False))
        col = F.col(self.column)
        if self.array:
            ok = F.forall(col, test) & (F.size(col) > 0) if self.every else F.exists(col, test)
        else:
            ok = test(col)
        ok = F.coalesce(ok, F.lit(False))
        return ~ok if self.negated else ok


@dataclass(frozen=True)
class Rule:
    """A label, and the tests that all must hold for it; without tests it always holds."""

    label: str | None
    tests: tuple[Test, ...] = ()

    def holds(self) -> Column:
        return all_of([t.holds() for t in self.tests])


def rule(label: str | None, *tests: Test, column: str = "key", **asks) -> Rule:
    """``rule("FLAG", has="~~")``: tests of one column by keyword (``not_has=...`` negates), then any others."""
    own = [Test(column, name.removeprefix("not_"), value, negated=name.startswith("not_")) for name, value in asks.items()]
    return Rule(label, (*own, *tests))


def classify(rules: Iterable[Rule], otherwise: str | Column | None = None) -> Column:
    """The label of the first rule that holds."""
    return first_match([(r.holds(), r.label) for r in rules], otherwise)


def looked_up(col: Column, table: Mapping[str, str], otherwise: str | Column | None = None) -> Column:
    """``table[col]``, or ``otherwise``."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    other = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return F.coalesce(F.element_at(F.create_map(*pairs), col), other) if pairs else other


def descriptor_type(descriptor: Column, types: Mapping[str, str], reference: str = "OBJECT", unknown: str = "UNKNOWN") -> Column:
    """The type of a class-file descriptor: by table, else ``reference`` for classes and arrays."""
    return looked_up(descriptor, types, F.when(matches(descriptor, r"(?s)[L\[].*"), reference).otherwise(unknown))


def registered_kind(role: Column, namespace: Column, key_role: str, kinds: Mapping[str, str], configurable: tuple[str, ...], otherwise: Column) -> Column:
    """The kind of an occurrence: a registered key of a configurable namespace is of that kind, other
    roles by table, and what has no entry is judged by ``otherwise``."""
    return F.when((role == key_role) & namespace.isin(*configurable), namespace).otherwise(looked_up(role, kinds, otherwise))


def evidence(strengths: Mapping[str, Iterable[Rule]], found: Iterable[Rule], doubts: Iterable[Rule]) -> Column:
    """A struct of one strength a field (each by its table, NONE otherwise) and two lists: the labels of all
    rules in ``found`` that hold, and of all in ``doubts``."""
    listed = lambda rules: F.array_compact(F.array(*[F.when(r.holds(), F.lit(r.label)) for r in rules]).cast("array<string>"))
    return F.struct(*[classify(rules, STRENGTHS[0]).alias(name) for name, rules in strengths.items()], listed(found).alias("evidence"), listed(doubts).alias("ambiguities"))


def merged_evidence(a: Column, b: Column, fields: Iterable[str]) -> Column:
    """The stronger of each field, and both lists without repeats, in order."""
    return F.struct(*[strongest([a[f], b[f]], STRENGTHS).alias(f) for f in fields], *[F.array_distinct(F.concat(a[c], b[c])).alias(c) for c in ("evidence", "ambiguities")])


def at_least(strength: Column, least: str) -> Column:
    return F.coalesce(ordinal(strength, STRENGTHS), F.lit(0)) >= STRENGTHS.index(least)


def normalized(df: DataFrame, kinds: Iterable[Rule], suspicious: Iterable[Rule], blocked: Iterable[Rule], reasons: Iterable[Rule], unresolved: str = "CATALOG_ONLY") -> DataFrame:
    """Identifiers (key, occurrence_kinds, editable, resolution, ...) in their final form.

    ``kind``: the only kind of the occurrences, else by ``kinds``.  ``suspicion``: by its table; a suspicious
    row loses its resolution.  ``editable`` stays where no rule of ``suspicious`` or ``blocked`` holds, and
    ``editability_reason`` says why not, by ``reasons``.
    """
    some = F.array_distinct(F.array_compact(F.array_remove("occurrence_kinds", "UNKNOWN")))
    out = df.withColumn("kind", F.when(F.size(some) == 1, some[0]).otherwise(classify(kinds, "UNKNOWN")))
    out = out.withColumn("suspicion", classify(suspicious))
    out = out.withColumn("resolution", F.when(F.col("suspicion").isNotNull(), unresolved).otherwise(F.col("resolution")))
    stop = any_of([r.holds() for r in blocked])
    out = out.withColumn("editable", F.col("editable") & F.col("suspicion").isNull() & ~stop)
    reason = first_match([(F.col("editable"), None), (F.col("suspicion").isNotNull(), "SUSPICIOUS_DISCOVERY")], classify(reasons))
    return out.withColumn("editability_reason", reason)


def blocked_token(name: Column, tokens: list[str], whole_words: tuple[str, ...] = ()) -> Column:
    """The first of ``tokens`` in a name (``whole_words`` only as words of their own), or null."""
    low, words = F.lower(name), words_of(name)
    return F.coalesce(*[F.when(F.array_contains(words, t) if t in whole_words else low.contains(t), F.lit(t)) for t in tokens], F.lit(None).cast("string"))


def policy_reason(name: Column, tokens: list[str], whole_words: tuple[str, ...], denied: str, allowed: list[str]) -> Column:
    """``token:<t>`` for a blocked token, ``denied`` for a name with that family's
    word outside the exact allow-list, else null."""
    token = blocked_token(name, tokens, whole_words)
    family = F.lower(name).contains(denied) & ~name.isin(*allowed)
    return first_match([(token.isNotNull(), F.concat(F.lit("token:"), token)), (family, "denied")])


def capability_name(name: Column, word: str) -> Column:
    return F.lower(name).contains(word.lower()) & name.endswith(")Z")
