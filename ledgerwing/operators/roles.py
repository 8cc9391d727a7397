"""Resolving a role from anchors: one owner, and independent routes to it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import all_of, first_match, single_or_null
from ..stores import saved


def resolve_roles(members: DataFrame, anchors: dict[str, Column], by: list[str], owner: str) -> DataFrame:
    """(by, one owner column a role, status): each anchor condition names a role's candidates.

    RESOLVED when every role has one owner and all are the same, PARTIAL when
    some roles have one, CONFLICT when their owners differ, else MISSING.
    """
    found = members.groupBy(*by).agg(*[single_or_null(F.when(cond, F.col(owner))).alias(role) for role, cond in anchors.items()], *[F.count_if(cond).alias(f"n_{role}") for role, cond in anchors.items()])
    roles = F.array(*[F.col(r) for r in anchors])
    known = F.array_compact(roles)
    status = first_match([
        (F.size(known) == 0, "MISSING"),
        (F.size(F.array_distinct(known)) > 1, "CONFLICT"),
        (F.size(known) < len(anchors), "PARTIAL"),
    ], "RESOLVED")
    return found.withColumn("status", status)


def delegates(members: DataFrame, by: list[str]) -> DataFrame:
    """(by, owner, name, delegate): members of one owner that a member calls, itself left out.

    members: (by, owner, name, calls), calls an array of ``owner->name``.
    """
    asked = members.select(*by, "owner", "name", F.explode("calls").alias("call"))
    targets = members.select(*by, "owner", F.col("name").alias("delegate"), F.concat("owner", F.lit("->"), "name").alias("call"))
    return asked.join(targets, [*by, "owner", "call"]).where("name <> delegate").select(*by, "owner", "name", "delegate").distinct()


def route_status(candidates: DataFrame, by: list[str], routes: dict[str, tuple[str, ...]], needed: tuple[str, ...] = ()) -> DataFrame:
    """(by, open_routes, status): which of several independent routes a build offers.

    candidates: (by, role, member).  A role counts with one member only.  READY: a route whose roles all count, and all
    ``needed`` ones; AMBIGUOUS: not so, but some role of a route has several members; else MISSING.
    """
    roles = candidates.groupBy(*by, "role").agg(F.count_distinct("member").alias("n"))
    held = roles.groupBy(*by).agg(F.collect_set(F.when(F.col("n") == 1, F.col("role"))).alias("one"), F.collect_set(F.when(F.col("n") > 1, F.col("role"))).alias("many"))
    whole = lambda names: all_of([F.array_contains("one", r) for r in names])
    out = held.withColumn("open_routes", F.array_compact(F.array(*[F.when(whole(names), F.lit(r)) for r, names in routes.items()])))
    unclear = F.arrays_overlap("many", F.array(*[F.lit(r) for names in (*routes.values(), needed) for r in names]))
    return out.select(*by, "open_routes", first_match([((F.size("open_routes") > 0) & whole(needed), "READY"), (unclear, "AMBIGUOUS")], "MISSING").alias("status"))


@dataclass(frozen=True)
class RoleSpec:
    """What a build's methods must look like to take a role; texts are fragments of a method's literals.

    family: roles whose methods take and return nothing and share an owner; direct, auxiliary: two independent routes, by a literal and
    through a helper that makes its own options; ``argument`` is their first parameter.
    """

    family: dict[str, str]
    direct: tuple[str, str]
    auxiliary: str
    observer: str
    factory: str
    options: str
    activity: str
    media: tuple[str, str]
    argument: str
    media_argument: str
    void: str
    runner: str
    activity_calls: tuple[str, ...]


@dataclass(frozen=True)
class RoleLabels:
    """Names of what can be missing, and of the outcomes."""

    family: str
    factory: str
    route: str
    media: str
    ambiguous: str
    unsupported: str
    known: str
    review: str


def resolve_build(methods: DataFrame, constructors: DataFrame, by: list[str], spec: RoleSpec, labels: RoleLabels, known: Column | None = None) -> DataFrame:
    """(by, roles, missing, status): which method of each build takes each role, from anchors, routes and the factory they share.

    methods: (by, ref, owner, name, parameters, returns, static, runnable, strings, invoked); constructors: (by, owner) of classes that can be
    made without arguments; known: whether a build's mapping was validated before.  A role is given to the only method that
    fits; either route is enough, and one that is absent doesn't harm the other.  Builds without methods have no row.
    """
    dealt = lambda df: df.hint("merge")  # noqa: E731  # saved rows repeat themselves and look small; sent to all at once they fill the driver
    void, none = F.col("returns") == spec.void, F.size("parameters") == 0
    has = lambda text: F.exists("strings", lambda s: s.contains(text))
    first, second = F.get("parameters", F.lit(0)), F.get("parameters", F.lit(1))
    pair = ~F.col("static") & (F.size("parameters") == 2) & (first == spec.argument) & void
    direct_name, direct_text = spec.direct
    family_ = [f"f{k}" for k in range(len(spec.family))]  # columns; a role's name may be anything
    flags = {f"is_{c}": has(t) & none & void for c, t in zip(family_, spec.family.values(), strict=True)} | {
        "is_direct": has(direct_text) & pair & second.startswith("L") & second.endswith(";"), "is_media": has(spec.media[1]) & (F.size("parameters") == 1) & (first == spec.media_argument) & void, "is_pair": pair,
        "is_helper": ~F.col("static") & (F.size("parameters") == 1) & (first == spec.argument) & void, "is_factory": F.col("static") & none & (F.col("returns") == F.col("owner")),
        "is_run": F.col("runnable") & ~F.col("static") & (F.col("name") == spec.runner) & none & void,
    }
    rows = methods.groupBy(*by, "ref").agg(*[F.first(c).alias(c) for c in methods.columns if c not in (*by, "ref")])
    rows = saved(rows.select("*", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()], second.alias("option")))
    made = constructors.select(*by, F.col("owner").alias("option")).distinct()
    lone = lambda flag, col="ref": F.when(F.count_if(F.col(flag)) == 1, F.min(F.when(F.col(flag), F.col(col))))
    anchors = rows.groupBy(*by).agg(
        *[lone(f"is_{c}").alias(f"r_{c}") for c in family_], *[lone(f"is_{c}", "owner").alias(f"o_{c}") for c in family_], *[F.count_if(F.col(f"is_{c}")).alias(f"n_{c}") for c in family_],
        lone("is_direct").alias("direct"), lone("is_direct", "owner").alias("d_owner"), lone("is_direct", "option").alias("d_option"), F.count_if("is_direct").alias("n_direct"), lone("is_media").alias("media"))

    makes = F.array_contains("invoked", F.concat("option", F.lit("-><init>()V")))
    asked = rows.where("is_helper").select(*by, F.col("ref").alias("helper"), "owner", "invoked", F.explode(F.array_distinct("invoked")).alias("callee"))
    delegates = rows.where("is_pair").select(*by, "owner", F.col("ref").alias("callee"), "option").join(dealt(made), [*by, "option"])
    single = asked.join(dealt(delegates), [*by, "owner", "callee"]).where(makes).groupBy(*by, "helper", "owner").agg(F.count("*").alias("_n"), F.min("callee").alias("delegate"), F.min("option").alias("a_option")).where("_n = 1")
    helpers = single.join(dealt(anchors.select(*by, "direct", "d_owner")), by).where("direct IS NULL OR (owner = d_owner AND delegate = direct)")
    one = F.count("*") == 1
    helpers = helpers.groupBy(*by).agg(F.count("*").alias("n_helpers"), *[F.when(one, F.min(c)).alias(n) for c, n in (("helper", "aux"), ("delegate", "delegate"), ("a_option", "a_option"), ("owner", "a_owner"))])
    now = anchors.join(dealt(helpers), by, "left").withColumn("owner", F.coalesce("d_owner", "a_owner"))
    factories = rows.where("is_factory").select(*by, "owner", "ref").join(dealt(now.select(*by, "owner")), [*by, "owner"]).groupBy(*by).agg(F.count("*").alias("n_factories"), F.when(one, F.min("ref")).alias("factory"))
    now = now.join(dealt(factories), by, "left").join(dealt(made.select(*by, F.col("option").alias("d_option"), F.lit(True).alias("d_made"))), [*by, "d_option"], "left")
    runs = rows.where("is_run").select(*by, "ref", "invoked").join(dealt(now.select(*by, "factory")), by).where(all_of([F.array_contains("invoked", F.col("factory")), *[F.array_contains("invoked", c) for c in spec.activity_calls]]))
    now = now.join(dealt(runs.groupBy(*by).agg(F.when(one, F.min("ref")).alias("activity"))), by, "left")

    there = lambda c: F.col(c).isNotNull()
    yes = lambda c: F.coalesce(c, F.lit(False))
    by_direct, by_aux = there("direct") & there("factory") & yes(F.col("d_made")), there("aux") & there("factory")
    owners = [F.col(f"o_{c}") for c in family_]
    family = yes(all_of([owners[0].isNotNull(), *[owners[0] == o for o in owners[1:]]]))
    entries = [(F.lit(r), F.col(f"r_{c}")) for r, c in zip(spec.family, family_, strict=True)] + [
        (F.lit(direct_name), F.when(by_direct, F.col("direct"))), (F.lit(spec.auxiliary), F.when(by_aux, F.col("aux"))), (F.lit(spec.observer), F.when(by_direct, F.col("direct")).when(by_aux, F.col("delegate"))),
        (F.lit(spec.activity), F.col("activity")), (F.lit(spec.factory), F.col("factory")), (F.lit(spec.options), F.when(by_direct | by_aux, F.concat(F.coalesce("d_option", "a_option"), F.lit("-><init>()V")))), (F.lit(spec.media[0]), F.col("media")),
    ]
    held = F.map_from_entries(F.filter(F.array(*[F.struct(k.alias("k"), v.alias("v")) for k, v in entries]), lambda e: e["v"].isNotNull()))
    missing = F.array_compact(F.array(F.when(~family, labels.family), F.when(~there("factory"), labels.factory), F.when(~(by_direct | by_aux), labels.route), F.when(~there("media"), labels.media)))
    several = F.greatest(*[F.col(f"n_{c}") for c in family_]) > 1
    unclear = several | ((F.col("n_direct") > 1) & ~by_aux) | yes((F.col("n_helpers") > 1) & ~by_direct) | yes(F.col("n_factories") > 1)
    status = first_match([((F.size("missing") > 0) & unclear, labels.ambiguous), (F.size("missing") > 0, labels.unsupported), (yes(known if known is not None else F.lit(False)), labels.known)], labels.review)
    return now.withColumn("missing", missing).select(*by, held.alias("roles"), "missing", status.alias("status"))
