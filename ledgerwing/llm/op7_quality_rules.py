"""Quality rules: base rules, then robust multivariate outliers by language and source.

DataFrame and SQL functions only.  The text is read once; what follows works on
a saved table of statistics.  Each (language, source), each language and the whole table
get a minimum covariance determinant estimate (MCD) of the statistic vectors:

1. Medians and quartile ranges standardise a group's vectors.
2. Three deterministic starts order them: plain lengths, the covariance of their directions (spatial
   signs) and that of their hyperbolic tangents.
3. A concentration step takes mean and covariance of the ``SUPPORT`` share with the least Mahalanobis
   distance.  After two steps the start with the least determinant goes on, until no group's
   determinant falls any more (the fall in a step is under ``SETTLED``, relative).
4. The covariance is scaled so that the median distance is the chi-square median (consistency).
5. A group's estimate is shrunk towards its language's, and that towards the whole table's, with the
   weight of ``PRIOR`` rows: a large group keeps its own, a few rows are judged by their parent's.

A document is rejected when its squared distance exceeds the chi-square quantile that one of ``1 / TAIL`` normal
vectors exceeds, so in a large corpus next to no clean document goes.  ``FLOORS`` is the least
spread of each statistic, about its sampling error in a text of some 40 words and 5 lines.

Means and covariances are grouped aggregates that combine before the shuffle, and quantiles come from
counts by narrow bins, which don't depend on how rows are dealt; so a hot source costs
no more than others.  The estimates, one row a group, are saved and joined back by size.

Rows that fail the base rules take no part in the estimates.  A whole table with under ``MIN_ROWS``
others is too small for an estimate: nothing more is rejected there.

Nulls: a null text has no words and fails the base rules; null language and
source each form a group value of their own.  Ties and repeated rows: all rows
are kept and judged; an empty table gives an empty result.  Input columns may have any name:
one that is also an output's comes back as ``in_<name>``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..stores import saved

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("f_length", "f_symbols", "f_lines", "f_repeats", "f_upper", "f_distinct")
OUTPUTS = (*COUNTS, "base_failed", "distance", "kept")
FLOORS = (0.10, 0.06, 0.25, 0.25, 0.08, 0.06)
SUPPORT = 0.75
PRIOR = 60.0
MIN_ROWS = 60
TAIL = 1e-4
SETTLED = 1e-2
MOST_STEPS = 12
WS = r"[\x20\x09-\x0D]+"


def chi_square_above(x: float, degrees: int) -> float:
    """Chance that a chi-square variable of even degrees exceeds x."""
    half, term, total = x / 2, 1.0, 1.0
    for k in range(1, degrees // 2):
        term *= half / k
        total += term
    return math.exp(-half) * total


def chi_square_point(tail: float, degrees: int) -> float:
    """The value that it exceeds with chance ``tail``."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_above(mid, degrees) > tail else (low, mid)
    return high


CHI2_MEDIAN = chi_square_point(0.5, len(FEATURES))
CUTOFF = chi_square_point(TAIL, len(FEATURES))


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the transforms need.

    5-word windows are compared by a 64-bit hash within their document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, WS), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({"_w": words, "_l": lines, "_t": text})
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "_j": F.array_join("_w", ""),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_distinct": F.size(F.array_distinct("_w")).cast("long"),
        "_h": F.expr("CASE WHEN size(_w) >= 5 THEN transform(sequence(0, size(_w) - 5), i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2), get(_w, i + 3), get(_w, i + 4))) ELSE cast(array() AS array<bigint>) END"),
    })
    df = df.withColumns({
        "word_chars": F.length("_j").cast("long"),
        "n_symbols": (F.length("_j") - F.length(F.regexp_replace("_j", r"[#*$%&|<>]+", ""))).cast("long"),
        "n_upper": (F.length("_j") - F.length(F.regexp_replace("_j", r"\p{Lu}+", ""))).cast("long"),
        "_s": F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (x, i) -> struct(x AS h, i AS p))) ELSE cast(array() AS array<struct<h: bigint, p: int>>) END"),
    })
    df = df.withColumn("_p", F.expr("sort_array(transform(filter(_s, (x, i) -> coalesce(x.h = get(_s, i - 1).h, false) OR coalesce(x.h = get(_s, i + 1).h, false)), x -> x.p))"))
    covered = "aggregate(_p, named_struct('last', -5, 'n', 0L), (a, q) -> named_struct('last', q, 'n', a.n + least(5, q - a.last)), a -> a.n)"
    return df.withColumn("n_repeat_words", F.expr(covered)).drop("_w", "_l", "_t", "_j", "_h", "_s", "_p")


def transformed(df: DataFrame) -> DataFrame:
    """The statistic vectors: logarithms of sizes, square roots of shares."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return df.withColumns({
        "f_length": F.log(chars / words),
        "f_symbols": F.sqrt(F.col("n_symbols") / chars),
        "f_lines": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        "f_repeats": F.sqrt(F.col("n_repeat_words") / words),
        "f_upper": F.sqrt(F.col("n_upper") / chars),
        "f_distinct": F.log(F.greatest("n_distinct", F.lit(1))) / F.greatest(F.log(words), F.lit(1.0)),
    })


#: Width of the bins of quantiles, for statistics (all within some 12) and for logarithms of distances.
BIN, LOG_BIN = 1 / 512, 1 / 64


def _quantiles(rows: DataFrame, by: list[str], value: str, width: float, shares: tuple[float, ...], name: str) -> DataFrame:
    """(by, n, name): an array with the middle of the bin at each share of a group's values, in order.

    The counts are dealt by group and bin, and saved, before the bins of a group (a bounded number) come together.
    """
    bins = saved(rows.groupBy(*by, F.floor(F.col(value) / F.lit(width)).alias("_bin")).agg(F.count("*").alias("_c")))
    upto = Window.partitionBy(*by).orderBy("_bin")
    sums = bins.withColumns({"_upto": F.sum("_c").over(upto), "_all": F.sum("_c").over(Window.partitionBy(*by))})
    at = [((F.min(F.when(F.col("_upto") >= F.col("_all") * s, F.col("_bin"))) + 0.5) * width) for s in shares]
    return sums.groupBy(*by).agg(F.max("_all").alias("n"), F.array(*at).alias(name))


def _cells(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i + 1)]


def _factored(df: DataFrame, keep: list, cell, raised, d: int) -> DataFrame:
    """``keep`` and the factor's cells l_i_j of each row, column after column, so that no expression grows with the others."""
    for j in range(d):
        inner = reduce(lambda a, b: a - b, [F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)], cell(j, j) + raised(j))
        df = df.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(inner, raised(j) / 4)))
        below = {f"l_{i}_{j}": reduce(lambda a, b: a - b, [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)], cell(i, j)) / F.col(f"l_{j}_{j}") for i in range(j + 1, d)}
        df = df.withColumns(below) if below else df
    return df.select(*keep, *[f"l_{i}_{j}" for i, j in _cells(d)])


def _distance(df: DataFrame, x, name: str, d: int) -> DataFrame:
    """``df`` with the squared length of ``x(i) - m_i`` solved by the factor l_i_j."""
    for i in range(d):
        rest = reduce(lambda a, b: a - b, [F.col(f"l_{i}_{j}") * F.col(f"_y_{j}") for j in range(i)], x(i) - F.col(f"m_{i}"))
        df = df.withColumn(f"_y_{i}", rest / F.col(f"l_{i}_{i}"))
    return df.withColumn(name, reduce(lambda a, b: a + b, [F.col(f"_y_{i}") * F.col(f"_y_{i}") for i in range(d)])).drop(*[f"_y_{i}" for i in range(d)])


def _concentrated(fit: DataFrame, estimates: DataFrame, by: list[str], d: int) -> DataFrame:
    """(by, m_i, c_i_j, l_i_j, logdet): one concentration step of each estimate (by, m_i, l_i_j, e_i)."""
    near = _distance(fit.join(estimates.drop("logdet", *[f"c_{i}_{j}" for i, j in _cells(d)]), "g"), lambda i: F.col(f"z_{i}"), "_d", d)
    near = near.withColumn("_log", F.log(F.lit(1.0) + F.col("_d"))).select(*by, "_log", *[f"z_{i}" for i in range(d)])
    limits = saved(_quantiles(near, by, "_log", LOG_BIN, (SUPPORT,), "q").select(*by, (F.col("q")[0] + LOG_BIN / 2).alias("_cut")))
    core = near.join(limits, by).where("_log <= _cut")
    means = [F.avg(f"z_{i}").alias(f"m_{i}") for i in range(d)]
    covs = [F.covar_pop(f"z_{i}", f"z_{j}").alias(f"c_{i}_{j}") for i, j in _cells(d)]
    moments = core.groupBy(*by).agg(*means, *covs).join(estimates.select(*by, *[f"e_{i}" for i in range(d)]), by)
    keep = [*by, *[f"m_{i}" for i in range(d)], *[f"c_{i}_{j}" for i, j in _cells(d)], *[f"e_{i}" for i in range(d)]]
    out = _factored(moments, keep, lambda i, j: F.col(f"c_{i}_{j}"), lambda i: F.col(f"e_{i}"), d)
    return saved(out.withColumn("logdet", reduce(lambda a, b: a + b, [2 * F.log(f"l_{i}_{i}") for i in range(d)])))


def mcd(fit: DataFrame, features: tuple[str, ...], floors: tuple[float, ...]) -> DataFrame:
    """(g, n, mu_i, s_i_j): minimum covariance determinant estimates of the features of each group g."""
    d = len(features)
    long = fit.select("g", F.posexplode(F.array(*features)).alias("f", "x"))
    middles = saved(_quantiles(long, ["g", "f"], "x", BIN, (0.25, 0.5, 0.75), "q"))
    floor = F.array(*map(F.lit, floors))
    of = lambda c, i: F.max(F.when(F.col("f") == i, c)).alias
    wide = middles.groupBy("g").agg(F.max("n").alias("n"), *[of(F.col("q")[1], i)(f"mid_{i}") for i in range(d)], *[of(F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, floor[F.col("f")]), i)(f"w_{i}") for i in range(d)])
    wide = saved(wide)
    z = fit.join(wide, "g").select("g", *[((F.col(f) - F.col(f"mid_{i}")) / F.col(f"w_{i}")).alias(f"z_{i}") for i, f in enumerate(features)])
    z = saved(z)

    # the starts: plain lengths, directions, hyperbolic tangents
    size = F.sqrt(F.greatest(reduce(lambda a, b: a + b, [F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(d)]), F.lit(1e-12)))
    sign, tanh = (lambda i: F.col(f"z_{i}") / size), (lambda i: F.tanh(f"z_{i}"))
    shapes = z.groupBy("g").agg(*[F.avg(v(i) * v(j)).alias(f"{n}_{i}_{j}") for n, v in (("sign", sign), ("tanh", tanh)) for i, j in _cells(d)])
    shapes = shapes.join(wide, "g").select("g", *[F.pow(F.lit(floors[i]) / F.col(f"w_{i}"), 2).alias(f"e_{i}") for i in range(d)], F.explode(F.array(*[
        F.struct(F.lit(k).alias("start"), *[(F.lit(float(i == j)) if n is None else F.col(f"{n}_{i}_{j}") / F.greatest(F.col(f"{n}_0_0"), F.lit(1e-6))).alias(f"c_{i}_{j}") for i, j in _cells(d)]) for k, n in enumerate((None, "sign", "tanh"))])).alias("s"))
    shapes = shapes.select("g", "s.*", *[f"e_{i}" for i in range(d)], *[F.lit(0.0).alias(f"m_{i}") for i in range(d)])
    keep = ["g", "start", *[f"m_{i}" for i in range(d)], *[f"e_{i}" for i in range(d)]]
    now = saved(_factored(shapes, keep, lambda i, j: F.col(f"c_{i}_{j}"), lambda i: F.lit(0.01), d))
    for _ in range(2):
        now = _concentrated(z, now, ["g", "start"], d)
    best = Window.partitionBy("g").orderBy("logdet", "start")
    now = saved(now.withColumn("_nth", F.row_number().over(best)).where("_nth = 1").drop("_nth", "start"))
    for _ in range(MOST_STEPS):
        after = _concentrated(z, now, ["g"], d)
        fall = after.select("g", F.col("logdet").alias("_new")).join(now.select("g", "logdet"), "g").agg(F.max(F.col("logdet") - F.col("_new"))).first()[0]
        now = after
        if fall is None or fall < SETTLED:
            break
    far = _distance(z.join(now, "g"), lambda i: F.col(f"z_{i}"), "_d", d).select("g", F.log(F.lit(1.0) + F.col("_d")).alias("_log"))
    middle = _quantiles(far, ["g"], "_log", LOG_BIN, (0.5,), "q").select("g", F.greatest((F.exp(F.col("q")[0]) - 1) / CHI2_MEDIAN, F.lit(0.25)).alias("_scale"))
    out = now.join(saved(middle), "g").join(wide, "g")
    return saved(out.select("g", "n", *[(F.col(f"mid_{i}") + F.col(f"w_{i}") * F.col(f"m_{i}")).alias(f"mu_{i}") for i in range(d)], *[(F.col(f"c_{i}_{j}") * F.col(f"w_{i}") * F.col(f"w_{j}") * F.col("_scale")).alias(f"s_{i}_{j}") for i, j in _cells(d)]))


def _shrunk(own: DataFrame, parent: DataFrame, d: int) -> DataFrame:
    """Estimates (up, g, n, mu_i, s_i_j) drawn to their parents' (g = up) with the weight of ``PRIOR`` rows."""
    names = [*[f"mu_{i}" for i in range(d)], *[f"s_{i}_{j}" for i, j in _cells(d)]]
    both = own.join(parent.select(F.col("g").alias("up"), *[F.col(c).alias(f"_p_{c}") for c in names]), "up")
    own_share = F.col("n") / (F.col("n") + F.lit(PRIOR))
    return both.select("g", "n", *[(own_share * F.col(c) + (1 - own_share) * F.col(f"_p_{c}")).alias(c) for c in names])


def mcd_distances(stats: DataFrame, use: str, keys: tuple[str, ...] = ("lang", "source"), features: tuple[str, ...] = FEATURES, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """``stats`` with ``distance``: the squared robust distance under the row's own group, null where
    the whole table is too small (or the group has no row to ``use``)."""
    d = len(features)
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    levels = [F.to_json(F.array(*[part(k) for k in keys[:n]])) if n else F.lit("all") for n in range(len(keys) + 1)]
    named = stats.withColumn("_levels", F.array(*levels))
    used = named.where(use)
    if used.limit(MIN_ROWS).count() < MIN_ROWS:
        return stats.withColumn("distance", F.lit(None).cast("double"))
    fit = used.select(F.explode(F.array_distinct("_levels")).alias("g"), *features)
    ups = saved(used.select(F.posexplode("_levels").alias("level", "g"), "_levels").select("level", "g", F.get("_levels", F.col("level") - 1).alias("up")).distinct())
    raw = mcd(fit, features, floors)
    now = raw.where("g = 'all'")
    for level in range(1, len(keys) + 1):
        now = saved(_shrunk(raw.join(ups.where(f"level = {level}").select("g", "up"), "g"), now, d))
    final = saved(_factored(now, ["g", *[F.col(f"mu_{i}").alias(f"m_{i}") for i in range(d)]], lambda i, j: F.col(f"s_{i}_{j}"), lambda i: F.lit(floors[i] ** 2), d))
    out = named.withColumn("g", F.element_at("_levels", -1)).join(final, "g", "left")
    return _distance(out, lambda i: F.col(features[i]), "distance", d).select(*stats.columns, "distance")


def _judged(docs: DataFrame, keys: tuple[str, ...], text_col: str, cutoff: float, keep: tuple[str, ...]) -> DataFrame:
    """(in_<kept column>, ``OUTPUTS``) of each row."""
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in dict.fromkeys((*keep, *keys, text_col))])
    counted = base_statistics(renamed, f"in_{text_col}")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    held = [F.col(f"`in_{c}`") for c in dict.fromkeys((*keep, *keys))]
    stats = saved(transformed(counted).withColumn("base_failed", failed).select(*held, *COUNTS, *FEATURES, "base_failed"))
    judged = mcd_distances(stats, "NOT base_failed", tuple(f"in_{c}" for c in keys))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)
    return judged.withColumn("kept", kept)


def quality_rules(docs: DataFrame, keys: tuple[str, ...] = ("lang", "source"), text_col: str = "text", cutoff: float = CUTOFF, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, counts, base_failed, distance, kept) for each row."""
    names = [F.col(f"`in_{c}`").alias(f"in_{c}" if c in OUTPUTS else c) for c in keep]
    return _judged(docs, keys, text_col, cutoff, keep).select(*names, *OUTPUTS)


def passing(docs: DataFrame, keys: tuple[str, ...] = ("lang", "source"), text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that all rules keep."""
    rows = _judged(docs, keys, text_col, cutoff, tuple(docs.columns)).where("kept")
    return rows.select(*[F.col(f"`in_{c}`").alias(c) for c in docs.columns])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
