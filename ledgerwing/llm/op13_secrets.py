"""Secret scans: patterns for labelled secrets, and two character Markov models for the rest.

DataFrame and SQL functions only; each text is judged in its own row, without a shuffle.

The patterns give the base spans: assignments to a secret's name, access keys, long hexadecimal runs.  The method adds
spans of kind ``random``: runs of ``CANDIDATE`` outside the base spans whose log-likelihood under a first-order Markov chain of
random strings exceeds that under a chain of ordinary identifiers by ``THRESHOLD`` nats or more.  Both chains count
transitions in labelled samples (``samples``): random ones are the corpus's own base matches and digests of ids
written in several alphabets; ordinary ones are the corpus's words, pairs of neighbouring words joined as identifiers join
them, words and numbers with digits, and repeated characters.  They come from ``SAMPLE_DOCS`` documents at most, chosen by a hash of the id.
The model is a table of ``len(ALPHABET) + 1`` squared whole numbers (thousandths of a nat), a literal in the plan.

Positions are code points.  Where a pattern matches, ``split`` gives the text between its matches, and sums of both
lengths give each match's place; the sums are taken in blocks, so long texts with very many matches stay cheap.

A null or empty text has no spans (the digest is that of the empty string).  Every row is judged for itself,
whatever its id; an empty table gives an empty result, and without samples the method adds nothing.  Other
columns play no part.  A very long run is one candidate.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stores import saved

#: The kinds in their order, the patterns, the group whose length counts, and its least length.
BASE = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
KINDS = (*[b[0] for b in BASE], "random")
#: The latter two as they are searched: a run that is too short is part of no match either way.
LONG_ACCESS, LONG_HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9_+/-]{16,}={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-="
SIZE = len(ALPHABET) + 1
SMOOTH = 0.5
THRESHOLD = 20.0
SAMPLE_DOCS = 1000
_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def before(lengths: Column) -> Column:
    """For each place of an array that isn't empty, the sum of all before it."""

    def blocks(lens: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(lens, b * _BLOCK + 1, _BLOCK)))
        empty = F.struct(F.expr("cast(array() as array<bigint>)").alias("at"), F.lit(0).cast("bigint").alias("sum"))
        return F.aggregate(whole, empty, lambda acc, x: F.struct(F.concat(acc["at"], F.array(acc["sum"])).alias("at"), (acc["sum"] + x).alias("sum")), lambda acc: acc["at"])

    def total(lens: Column) -> Column:
        return F.aggregate(lens, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    inside = lambda lens, i: total(F.slice(lens, i - i % _BLOCK + 1, i % _BLOCK))
    return let(lengths, lambda lens: let(blocks(lens), lambda at: F.transform(lens, lambda _, i: F.get(at, F.floor(i / _BLOCK).cast("int")) + inside(lens, i))))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of all matches, left to right; ``value`` is the group's text."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    sized = F.arrays_zip(F.transform(hits, lambda x: F.length(x).cast("bigint")).alias("hit"), F.transform(gaps, lambda x: F.length(x).cast("bigint")).alias("gap"), values.alias("value"))

    def placed(parts: Column) -> Column:  # the last part is the gap after the last match
        at = before(F.transform(parts, lambda p: F.coalesce(p["hit"], F.lit(0)) + p["gap"]))
        return F.slice(F.zip_with(parts, at, lambda p, a: F.struct((a + p["gap"]).alias("start"), (a + p["gap"] + p["hit"]).alias("end"), p["value"].alias("value"))), F.lit(1), F.size(parts) - 1)

    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint, value: string>>)")
    return F.when(text.rlike(pattern), let(sized, placed)).otherwise(none)


def spans_of(matches: Column, kind: int, least: int) -> Column:
    """The matches whose value is long enough, as (start, kind, end)."""
    long = F.filter(matches, lambda m: F.length(m["value"]) >= least)
    return F.transform(long, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def codes(run: Column) -> Column:
    """The places of a run's characters in ``ALPHABET``, from 1; 0 stands for any other."""
    return F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


# --- the models ------------------------------------------------------------

def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE_DOCS) -> DataFrame:
    """(run, random): labelled strings of at most about ``most`` documents."""
    n = max(1, docs.count())
    key = F.xxhash64(F.col(f"`{id_col}`").cast("string"))
    some = saved(docs.where(F.pmod(key, F.lit(n)) < most).select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")))
    base = [F.regexp_extract_all("text", F.lit(p), F.lit(g)) for p, g in ((BASE[0][1], 2), (LONG_ACCESS, 0), (LONG_HEX, 0))]
    digest = lambda k: F.sha2(F.concat(F.lit(f"{k}:"), "id"), 256)
    drawn = lambda k: F.base64(F.unhex(digest(k)))
    made = F.array(drawn(1), F.translate(drawn(2), "+/", "-_"), F.regexp_replace(drawn(3), "[+/=]", ""), F.regexp_replace(drawn(4), "[+/=]", ""), digest(5), F.upper(F.regexp_replace(drawn(6), "[+/=]", "")))
    random = some.select(F.explode(F.concat(made, *base)).alias("run"), F.lit(True).alias("random"))

    rest = F.regexp_replace(F.regexp_replace("text", BASE[0][1], " "), f"{LONG_ACCESS}|{LONG_HEX}", " ")
    words = some.select(F.regexp_extract_all(rest, F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w")).where("size(w) > 1")
    pairs = words.select(F.explode(F.expr("transform(slice(w, 1, size(w) - 1), (x, i) -> struct(x AS a, w[i + 1] AS b))")).alias("p")).select("p.*")
    number = lambda m: F.pmod(F.xxhash64("a", "b"), F.lit(m)).cast("string")
    ways = F.array(
        F.col("a"), F.concat_ws("_", "a", "b"), F.concat(F.lower("a"), F.initcap("b")), F.concat_ws("-", "a", "b"), F.concat_ws("/", "a", "b"), F.concat_ws("_", F.upper("a"), F.upper("b")),
        F.concat("a", number(100)), F.concat_ws("-", number(10_000), number(12), number(28)), number(10**12), F.concat_ws("_", "a", number(1000), "b"),
        F.repeat(F.substr(F.lit(ALPHABET), (F.pmod(F.xxhash64("b"), F.lit(len(ALPHABET))) + 1).cast("int"), F.lit(1)), F.lit(9)),
    )
    one = F.get(ways, F.pmod(F.xxhash64("b", "a"), F.size(ways)).cast("int"))  # each pair of words in one of the ways
    return random.union(pairs.select(one.alias("run"), F.lit(False).alias("random")))


def train(labelled: DataFrame, smooth: float = SMOOTH) -> list[int]:
    """Log-likelihood ratio of each transition (from * SIZE + to), random over ordinary, in thousandths of a nat.

    Without samples of either kind all are 0.  The counts are at most 2 * SIZE² rows.
    """
    steps = labelled.select("random", codes(F.col("run")).alias("c")).select("random", F.explode(F.expr("transform(c, (x, i) -> coalesce(get(c, i - 1), 0) * %d + x)" % SIZE)).alias("step"))
    counts = {(r["random"], r["step"]): r["n"] for r in steps.groupBy("random", "step").agg(F.count("*").alias("n")).collect()}
    if len({k for k, _ in counts}) < 2:
        return [0] * SIZE * SIZE
    out = []
    for prev in range(SIZE):
        own = {kind: [counts.get((kind, prev * SIZE + to), 0) + smooth for to in range(SIZE)] for kind in (True, False)}
        total = {kind: sum(v) for kind, v in own.items()}
        out += [round(1000 * math.log(r / total[True] * total[False] / o)) for r, o in zip(own[True], own[False], strict=True)]
    return out


def ratio(run: Column, table: list[int]) -> Column:
    """Thousandths of a nat by which a run is likelier as a random string."""
    model = F.expr(f"cast(split('{','.join(map(str, table))}', ',') as array<int>)")  # folded into one literal
    start = F.struct(F.lit(0).alias("from"), F.lit(0).cast("bigint").alias("sum"))
    step = lambda acc, c: F.struct(c.alias("from"), (acc["sum"] + F.get(model, acc["from"] * SIZE + c)).alias("sum"))
    return F.aggregate(codes(run), start, step, lambda acc: acc["sum"])


# --- the scan --------------------------------------------------------------

def scan(docs: DataFrame, table: list[int], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of each row of ``docs``."""
    text = F.col("text")
    df = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    df = df.withColumn("assigned", found(text, BASE[0][1], 2))
    # text between assignments, with its place; the other base spans of these parts lie within candidates
    parts = F.split(text, BASE[0][1], -1)
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("assigned", lambda m: m["end"]))
    within = F.flatten(F.zip_with(parts, ends, lambda part, at: F.transform(found(part, CANDIDATE), lambda m: F.struct((m["start"] + at).alias("start"), (m["end"] + at).alias("end"), m["value"].alias("value")))))
    df = df.withColumn("within", within)
    random = F.filter("within", lambda m: ~m["value"].rlike(f"{LONG_ACCESS}|{LONG_HEX}") & (ratio(m["value"], table) >= round(1000 * threshold)))
    df = df.withColumns({
        "s0": spans_of(F.col("assigned"), 0, BASE[0][3]),
        "s1": spans_of(found(text, LONG_ACCESS), 1, BASE[1][3]),
        "s2": spans_of(found(text, LONG_HEX), 2, BASE[2][3]),
        "s3": spans_of(random, 3, 0),
    })
    names = F.array(*map(F.lit, KINDS))
    written = lambda *cols: F.array_join(F.transform(F.sort_array(F.concat(*cols)), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    counts = [F.size(f"s{k}").cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return df.select(id_col, *counts, F.sha2(written("s0", "s1", "s2"), 256).alias("base_sha256"), written("s0", "s1", "s2", "s3").alias("spans"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(samples(docs)))
