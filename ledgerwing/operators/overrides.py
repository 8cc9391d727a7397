"""User overrides against a catalog: suspension, claims and arbitration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import fits_descriptor, stored_type, stored_value
from ..functions.rules import all_of, any_of, first_match
from ..stores import saved

#: Getter descriptors, as class files write them, that a value type may be served by.
DESCRIPTORS = {"BOOLEAN": ("()Z",), "INT": ("()I", "()B", "()S", "()C"), "LONG": ("()J",), "FLOAT": ("()F",), "DOUBLE": ("()D",), "STRING": ("()Ljava/lang/String;",)}


def compatible_getter(value_type: Column, descriptor: Column) -> Column:
    return first_match([(value_type == t, descriptor.isin(*ds)) for t, ds in DESCRIPTORS.items()], F.lit(False))


def reconcile(overrides: DataFrame, catalog: DataFrame, key: str = "preference_key", history: DataFrame | None = None, stored_names: DataFrame | None = None) -> DataFrame:
    """Each override with its name, decoded value and ``reason`` of suspension (null: active).

    overrides: (key, raw).  catalog: (key, name, value_type, editable, n_getters,
    class_name, method_name, descriptor).  A name comes from the catalog, else
    ``stored_names``, else ``history`` (key, name).
    """
    named = catalog.select(key, F.col("name").alias("_current"), "value_type", "editable", "n_getters", "class_name", "method_name", "descriptor", F.lit(True).alias("_known"))
    df = overrides.join(named, key, "left")
    names = [F.col("_current")]
    for place, more in (("_stored", stored_names), ("_history", history)):
        if more is not None:
            df = df.join(more.select(key, F.col("name").alias(place)), key, "left")
            names.append(F.col(place))
    df = df.withColumns({"kind": stored_type(F.col("raw")), "value": stored_value(F.col("raw")), "name": F.coalesce(*names)})
    missing = F.col("_known").isNull()
    served = F.col("editable") & (F.col("n_getters") == 1) & compatible_getter(F.col("value_type"), F.col("descriptor"))
    reason = first_match([
        (missing, "SUSPENDED_MAPPING_MISSING"),
        (F.col("value").isNull(), "SUSPENDED_INVALID_VALUE"),
        (F.col("kind") != F.col("value_type"), "SUSPENDED_TYPE_CHANGED"),
        (~F.coalesce(served, F.lit(False)), "SUSPENDED_MAPPING_AMBIGUOUS"),
        (~fits_descriptor(F.col("kind"), F.col("descriptor"), F.col("value")), "SUSPENDED_INVALID_VALUE"),
    ])
    return df.withColumn("reason", reason).drop("_current", "_stored", "_history", "_known")


def claim(df: DataFrame, token: list[str], order: str, name: str = "reason") -> DataFrame:
    """The first active row of each token keeps it; later ones are suspended.

    Only rows without a reason and with a whole token take part, so a suspended one never blocks another; the
    others pass by without a shuffle.  Rows are staged first: both parts test their reason, and would else each work it out.
    """
    df = saved(df)
    taking = all_of([F.col(name).isNull(), *[F.col(c).isNotNull() for c in token]])
    place = F.row_number().over(Window.partitionBy(*token).orderBy(order))
    ranked = df.where(taking).withColumn("_place", place)
    ranked = ranked.withColumn(name, F.when(F.col("_place") > 1, "SUSPENDED_TARGET_COLLISION")).drop("_place")
    return ranked.unionByName(df.where(~taking))


def arbitrate(claims: DataFrame, token: list[str], source: str, priority: tuple[str, ...], order: str) -> DataFrame:
    """``claims`` with ``owner`` (true for the winner of its token): earlier sources first, then ``order``."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(source))
    w = Window.partitionBy(*token).orderBy(rank, order)
    return claims.withColumn("owner", F.row_number().over(w) == 1)


def reserved(claims: DataFrame, owners: DataFrame, token: list[str]) -> DataFrame:
    """Claims whose token no owner holds."""
    return claims.join(owners.select(*token), token, "left_anti")


def readiness(states: list[tuple[Column, str]], last: str) -> Column:
    """What keeps published overrides from taking effect: the first state of the caller's table whose condition doesn't hold
    (unknown counts as not holding), else ``last``."""
    return first_match([(~F.coalesce(holds, F.lit(False)), name) for holds, name in states], last)


def hidden_keys(hidden: DataFrame, builds: DataFrame, key: str) -> DataFrame:
    """Hidden keys that were hidden under the present build."""
    return hidden.join(builds.select(key, "build"), [key, "build"], "left_semi")


def advanced_reason(configurable: tuple[str, ...], resolutions: tuple[str, ...], blocked: Column) -> Column:
    """Why an identifier can't be overridden by its getter alone, null where it can; of columns
    (kind, value_type, resolution, n_getters, descriptor, n_parameters, static_init, opcode_sha, instruction_count, editable)."""
    served = compatible_getter(F.col("value_type"), F.col("descriptor")) & (F.element_at(F.split("descriptor", r"\)"), 1) == "(")
    return first_match([
        (~F.col("kind").isin(*configurable), "NOT_CONFIGURABLE"),
        (blocked, "BLOCKED"),
        (~F.col("value_type").isin(*DESCRIPTORS), "TYPE_UNSUPPORTED"),
        (~F.coalesce(F.col("resolution").isin(*resolutions), F.lit(False)), "UNRESOLVED"),
        (F.col("n_getters") != 1, "GETTER_NOT_UNIQUE"),
        (~served | (F.col("n_parameters") > 0) | F.col("static_init"), "SIGNATURE"),
        ((F.coalesce(F.trim("opcode_sha"), F.lit("")) == "") | (F.col("instruction_count") <= 0), "NO_FINGERPRINT"),
        (F.col("editable"), "IN_NORMAL_EDITOR"),
    ])


def target_reason(candidates: DataFrame, targets: DataFrame, key: list[str], fields: dict[str, str], name: str = "reason") -> DataFrame:
    """``candidates`` with the first reason against each, null where it is one of the reviewed ``targets`` (key, fields).

    A candidate without a target is NOT_A_TARGET; then each field of the target that isn't null has to be equal,
    in the order of ``fields`` (field to reason).
    """
    known = targets.select(*key, F.struct(*fields).alias("_target"))
    checks = [(F.col(f"_target.{f}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_target.{f}")), reason) for f, reason in fields.items()]
    return candidates.join(known, key, "left").withColumn(name, first_match([(F.col("_target").isNull(), "NOT_A_TARGET"), *checks])).drop("_target")


def consent_allowed(status: Column, roles_: Column, validated: str, needed: list[tuple[str, ...]]) -> Column:
    """Whether an explicit consent may enable a build: it is validated, and of each tuple of roles one is known."""
    known = lambda r: F.coalesce(F.trim(F.element_at(roles_, r)) != "", F.lit(False))
    return F.coalesce(status == validated, F.lit(False)) & all_of([any_of([known(r) for r in some]) for some in needed])


def handed_over(mappings: DataFrame, records: DataFrame, stored: DataFrame, key: str, build: Column | str) -> tuple[DataFrame, DataFrame]:
    """Mappings without those whose key an active record of the build has taken over, and the records that did.

    records: (key, build, active, mode, previous_raw, previous_name); stored: (key, raw, name).  A record takes its
    key over only while the override that it found is still stored as it was.
    """
    as_col = build if isinstance(build, Column) else F.lit(build)
    live = records.where(F.col("active") & F.col("mode").isNotNull() & (F.col("build") == as_col))
    single = live.groupBy(key).agg(F.count("*").alias("_n"), F.first("previous_raw").alias("previous_raw"), F.first("previous_name").alias("previous_name")).where("_n = 1")
    whole = single.join(stored.select(key, "raw", "name"), key).where(F.col("raw").eqNullSafe(F.col("previous_raw")) & F.col("name").eqNullSafe(F.col("previous_name"))).select(key)
    return mappings.join(whole, key, "left_anti"), live.join(whole, key, "left_semi")


def compatible_getters(methods: DataFrame, diagnostic: Column) -> DataFrame:
    """Methods that can serve a value: neither static nor with parameters, of a type that some value type has, no diagnostics.

    methods: (static, parameters, descriptor).
    """
    served = F.col("descriptor").isin(*[d for own in DESCRIPTORS.values() for d in own])
    return methods.where(~F.col("static") & (F.size("parameters") == 0) & served & ~diagnostic)


def matching_records(records: DataFrame, methods: DataFrame, fingerprint: tuple[str, ...]) -> DataFrame:
    """Records whose method is there unchanged: all fields of its fingerprint equal, nulls too."""
    same = all_of([F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in fingerprint])
    return records.alias("r").join(methods.select(*fingerprint).distinct().alias("m"), same, "left_semi")
