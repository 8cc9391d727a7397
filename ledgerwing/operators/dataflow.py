"""What methods do with fields, constants and calls.

What windows over a method's ordered instructions can say is said with windows; what depends on the ways through it comes
from the kernels of ``flow``, one shuffle whatever the length of the ways.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import first_match, single_or_null
from ..stores import saved
from . import flow


def successors(instructions: DataFrame, by: list[str]) -> DataFrame:
    """(by, idx, next): control-flow edges of instructions (idx, offset, op, targets).

    ``op`` is one of GOTO, IF, SWITCH, RETURN, THROW or any other; targets are
    offsets in code units.  An offset that is no instruction's start gives no edge.
    """
    nxt = F.lead("idx").over(Window.partitionBy(*by).orderBy("idx"))
    df = instructions.withColumn("_fall", F.when(~F.col("op").isin("GOTO", "RETURN", "THROW"), nxt))
    fall = df.where("_fall IS NOT NULL").select(*by, "idx", F.col("_fall").alias("next"))
    jumps = instructions.where(F.col("op").isin("GOTO", "IF", "SWITCH")).select(*by, "idx", F.explode("targets").alias("offset"))
    places = instructions.select(*by, "offset", F.col("idx").alias("next"))
    return fall.union(jumps.join(places, [*by, "offset"]).select(*by, "idx", "next")).distinct()


def method_fingerprint(instructions: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_instructions, opcode_sha, fields, calls): hash of opcodes in order, distinct references."""
    ops = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "opcode"))), lambda x: x["opcode"]), ",")
    refs = lambda kind: F.array_sort(F.collect_set(F.when(F.col("ref_kind") == kind, F.col("ref"))))
    return instructions.groupBy(*by).agg(F.count("*").alias("n_instructions"), F.sha2(ops.cast("binary"), 256).alias("opcode_sha"), refs("field").alias("fields"), refs("method").alias("calls"))


def returned_constant(instructions: DataFrame, by: list[str]) -> DataFrame:
    """(by, value): the constant every return gives back, where all returns agree.

    Of straight-line getters: a return takes the latest constant put in its register.
    """
    w = Window.partitionBy(*by, "register").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    held = instructions.withColumn("_held", F.last(F.when(F.col("op") == "CONST", F.col("literal")), ignorenulls=True).over(w))
    returns = held.where("op = 'RETURN'").groupBy(*by).agg(single_or_null("_held").alias("value"), F.count_if(F.col("_held").isNull()).alias("_open"))
    return returns.where("_open = 0 AND value IS NOT NULL").select(*by, "value")


def nearby_literal(instructions: DataFrame, by: list[str], back: int = 8, ahead: int = 13) -> DataFrame:
    """(by, idx, literal) for KEY rows: the constant next to a key, ahead first, within a
    window that a call ends."""
    keys = instructions.where("op = 'KEY'").select(*by, F.col("idx").alias("k"))
    near = keys.join(instructions, by).where(F.col("idx").between(F.col("k") - back, F.col("k") + ahead))
    stop = near.where("op = 'INVOKE' AND idx > k").groupBy(*by, "k").agg(F.min("idx").alias("_stop"))
    consts = near.where("op = 'CONST'").join(stop, [*by, "k"], "left").where("_stop IS NULL OR idx < _stop")
    best = consts.groupBy(*by, "k").agg(F.min_by("literal", F.struct((F.col("idx") < F.col("k")).alias("behind"), F.abs(F.col("idx") - F.col("k")).alias("gap"))).alias("literal"))
    return best.select(*by, F.col("k").alias("idx"), "literal")


def branch_decisions(instructions: DataFrame, by: list[str]) -> DataFrame:
    """(by, idx, invoked, opcode, polarity): branches on the result of the call just before them."""
    w = Window.partitionBy(*by).orderBy("idx")
    df = instructions.withColumns({"_p1": F.lag("op").over(w), "_p2": F.lag("op", 2).over(w), "_call": F.lag("ref", 2).over(w), "_reg": F.lag("register").over(w)})
    hit = df.where("op = 'IF' AND _p1 = 'MOVE_RESULT' AND _p2 = 'INVOKE' AND _reg = register")
    return hit.select(*by, "idx", F.col("_call").alias("invoked"), "opcode", F.when(F.col("opcode") == "if-eqz", "TRUE_FALLS_THROUGH").when(F.col("opcode") == "if-nez", "FALSE_FALLS_THROUGH").otherwise("OTHER").alias("polarity"))


#: Operations that write their register, and those that read it.
WRITES, READS = ("CONST", "GET", "MOVE_RESULT"), ("RETURN", "SPUT", "IPUT", "IF")


def reaching(instructions: DataFrame, by: list[str]) -> DataFrame:
    """Each reading instruction with ``src_op`` and ``src_ref`` of the write that reaches it in straight-line code.

    The result of a call carries the call's reference.  No write before it gives nulls.
    """
    order = Window.partitionBy(*by).orderBy("idx")
    origin = F.when(F.col("op") == "MOVE_RESULT", F.lag("ref").over(order)).otherwise(F.col("ref"))
    marked = instructions.withColumn("_w", F.when(F.col("op").isin(*WRITES), F.struct(F.col("op").alias("op"), origin.alias("ref"))))
    before = Window.partitionBy(*by, "register").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    seen = marked.withColumn("_s", F.last("_w", ignorenulls=True).over(before)).where(F.col("op").isin(*READS))
    return seen.select(*instructions.columns, F.col("_s.op").alias("src_op"), F.col("_s.ref").alias("src_ref"))


def returned_field(instructions: DataFrame, by: list[str]) -> DataFrame:
    """(by, field): the only field whose value a method's returns give back."""
    returns = reaching(instructions, by).where("op = 'RETURN'")
    proven = returns.groupBy(*by).agg(single_or_null(F.when(F.col("src_op") == "GET", F.col("src_ref"))).alias("field"), F.count_if(~F.coalesce(F.col("src_op") == "GET", F.lit(False))).alias("_other"))
    return proven.where("_other = 0 AND field IS NOT NULL").select(*by, "field")


def field_moves(instructions: DataFrame, by: list[str]) -> DataFrame:
    """(by, source, target): fields that store another field's value."""
    rows = reaching(instructions, by).where("op IN ('SPUT', 'IPUT') AND src_op = 'GET'")
    return rows.select(*by, F.col("src_ref").alias("source"), F.col("ref").alias("target")).distinct()


# --- over all ways through a method -------------------------------------------


def value_origins(instructions: DataFrame, edges: DataFrame | None, by: list[str], trail: int = 8) -> DataFrame:
    """(by, idx, register, origin, trail): for every read, the instructions that its value may come from.

    A MOVE or TRANSFORM is followed to what it reads; a read that no write reaches gives nothing.
    """
    return flow.value_flow(instructions, edges, by, trail).where("origin IS NOT NULL").select(*by, "idx", "register", "origin", "trail")


def proven_returns(instructions: DataFrame, edges: DataFrame | None, by: list[str]) -> DataFrame:
    """(by, field): the only field that all returns of a method give back, whichever way they are reached."""
    found = flow.value_flow(instructions, edges, by, only=("RETURN",))
    plain = F.coalesce((F.col("from_op") == "GET") & (F.size("trail") == 0), F.lit(False))
    out = found.groupBy(*by).agg(single_or_null(F.when(F.col("from_op") == "GET", F.col("from_ref"))).alias("field"), F.count_if(~plain).alias("_other"))
    return out.where("_other = 0 AND field IS NOT NULL").select(*by, "field")


def stored_values(instructions: DataFrame, edges: DataFrame | None, by: list[str], origin_op: str) -> DataFrame:
    """(by, target, source, trail, certain): fields that store what came from an ``origin_op`` (INVOKE: a call's result,
    GET: another field), and whether it can come from nowhere else."""
    puts = flow.value_flow(instructions, edges, by, only=("PUT",)).where(F.col("from_op") == origin_op)
    return puts.groupBy(*by, F.col("ref").alias("target"), F.col("from_ref").alias("source")).agg(F.min("trail").alias("trail"), F.max(F.col("n_ways") == 1).alias("certain"))


def constant_writes(instructions: DataFrame, edges: DataFrame | None, by: list[str]) -> DataFrame:
    """(by, field, value): the constant that a PUT stores, where it can store no other."""
    puts = flow.value_flow(instructions, edges, by, only=("PUT",))
    out = puts.groupBy(*by, "idx", "ref").agg(single_or_null("from_literal").alias("value"), F.count_if(~F.coalesce(F.col("from_op") == "CONST", F.lit(False))).alias("_other"))
    return out.where("_other = 0 AND value IS NOT NULL").select(*by, F.col("ref").alias("field"), "value").distinct()


def registrations(instructions: DataFrame, edges: DataFrame | None, by: list[str]) -> DataFrame:
    """(by, field, key, value, status): what the calls whose results fields store were given, over all ways through a method.

    A call's only string constant is the key and its only number the default; RESOLVED if the stored call and its key are the
    only ones possible, else AMBIGUOUS.
    """
    found = saved(flow.value_flow(instructions, edges, by, only=("INVOKE", "PUT")))
    text = F.when(F.col("from_op") == "STRING", F.col("from_literal"))
    calls = found.where("op = 'INVOKE'").groupBy(*by, F.col("idx").alias("origin")).agg(
        F.count_distinct(text).alias("n_keys"), F.min(text).alias("key"), single_or_null(F.when(F.col("from_op") == "NUMERIC", F.col("from_literal"))).alias("value"))
    stored = found.where("op = 'PUT'").select(*by, F.col("ref").alias("field"), "origin", "n_ways").join(calls, [*by, "origin"])
    out = stored.where("n_keys > 0").groupBy(*by, "field").agg(F.count_distinct("key").alias("_k"), F.max("n_keys").alias("_n"), F.max("n_ways").alias("_w"), F.min("key").alias("key"), single_or_null("value").alias("value"))
    sure = (F.col("_k") == 1) & (F.col("_n") == 1) & (F.col("_w") == 1)
    return out.select(*by, "field", F.when(sure, F.col("key")).alias("key"), F.when(sure, F.col("value")).alias("value"), F.when(sure, "RESOLVED").otherwise("AMBIGUOUS").alias("status"))


def argument_places(calls: DataFrame, by: list[str], wide: tuple[str, ...] = ("J", "D")) -> DataFrame:
    """(by, place, word, kind): where each argument of a call lies among its registers; LONG and DOUBLE ones take two words.

    calls: (kinds), the argument types in order.
    """
    rows = calls.select(*by, F.posexplode("kinds").alias("place", "kind"))
    size = F.when(F.col("kind").isin(*wide), 2).otherwise(1)
    return rows.withColumn("word", (F.sum(size).over(Window.partitionBy(*by).orderBy("place")) - size).cast("int")).select(*by, "place", "word", "kind")


def positional_registration(calls: DataFrame, by: list[str], after: int = 1, wide: tuple[str, ...] = ("J", "D")) -> DataFrame:
    """(by, key, value): the constant ``after`` places behind (or before) a call's only string argument.

    calls: (kinds, words): argument types, and the constant in each register word (null: not constant).
    """
    places = argument_places(calls, by, wide).join(calls.select(*by, "words"), by).withColumn("held", F.get("words", F.col("word")))
    keys = places.where("kind = 'Ljava/lang/String;' AND held IS NOT NULL")
    single = keys.groupBy(*by).agg(F.count("*").alias("_n"), F.min("held").alias("key"), F.min("place").alias("_at")).where("_n = 1")
    beside = places.select(*by, (F.col("place") - after).alias("_at"), F.col("held").alias("value"))
    return single.join(beside, [*by, "_at"]).where("value IS NOT NULL").select(*by, "key", "value")


def referencing(methods: DataFrame, fields: DataFrame, by: list[str], lists: str = "fields") -> DataFrame:
    """Methods (by) that refer to any of ``fields`` (field)."""
    return methods.select(*by, F.explode(lists).alias("field")).join(fields.select("field"), "field", "left_semi").select(*by).distinct()


@dataclass(frozen=True)
class CallRules:
    """Names for what becomes of a call's result.  uses: (operation, name), strongest first, RECEIVER for a call made on it;
    the others in the order in which they are tested after ``dropped``."""

    uses: tuple[tuple[str, str], ...]
    dropped: str
    shared: str
    other: str
    overwritten: str
    unused: str


def invoke_outcomes(instructions: DataFrame, edges: DataFrame | None, by: list[str], rules: CallRules) -> DataFrame:
    """(by, idx, outcome): what becomes of each call's result, over all ways through a method.

    Where a named use may also see another value, the origin is ambiguous, which outweighs all; else the strongest use
    counts, then any use without a name.
    """
    known = F.array(*[F.lit(op) for op, _ in rules.uses])
    tests = [(~F.col("captured"), rules.dropped), (F.arrays_overlap("shared", known), rules.shared), *[(F.array_contains("uses", op), name) for op, name in rules.uses]]
    tests += [(F.size(F.array_except("uses", F.array(F.lit("MOVE")))) > 0, rules.other), (F.col("overwritten"), rules.overwritten)]
    return flow.call_uses(instructions, edges, by).select(*by, "idx", first_match(tests, rules.unused).alias("outcome"))
