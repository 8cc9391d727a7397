"""Graph traversals as loops of joins; each round is written, so lineage stays short."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import first_match
from ..stores import heavy_join, saved, saved_as_measured


#: Budgets up to which a node's edges are ranked and cut before a search; larger ones rarely leave any out.
CUT = 1000
#: Steps of roots, and edges, that a task of ``reach_sums`` holds: four bytes each, or eight.
TILE = 48_000_000
#: Edges that travel to a tile as one row.
CHUNK = 100_000


def distances(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth): fewest edges (src, dst) from any seed, up to ``max_depth``."""
    seen = saved_as_measured(seeds.select("node", F.lit(0).alias("depth")).distinct())
    front = seen
    for depth in range(1, max_depth + 1):
        step = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = saved_as_measured(step.join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth")))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def caller_edges(calls: DataFrame, implements: DataFrame, extends: DataFrame, methods: DataFrame) -> DataFrame:
    """(src, dst, via, ordinal): from each method to those that may call it.

    calls: (caller, callee, ordinal); implements: (class_name, interface); extends: (class_name, superclass);
    methods: (class_name, member), a signature being ``class->member``.  A call of an interface's or a superclass's
    member also reaches the class's own; ``via`` then names it, marked ``#dispatch`` or ``#super``.
    """
    direct = calls.select(F.col("callee").alias("src"), F.col("caller").alias("dst"), F.lit(None).cast("string").alias("via"), "ordinal")
    kinds = [implements.select("class_name", F.col("interface").alias("base"), F.lit("#dispatch").alias("mark")), extends.select("class_name", F.col("superclass").alias("base"), F.lit("#super").alias("mark"))]
    own = methods.join(kinds[0].union(kinds[1]), "class_name").select(F.concat("class_name", F.lit("->"), "member").alias("src"), F.concat("base", F.lit("->"), "member").alias("callee"), "mark")
    through = own.join(calls, "callee").select("src", F.col("caller").alias("dst"), F.concat("callee", "mark").alias("via"), "ordinal")
    return direct.union(through)


def budgeted_search(starts: DataFrame, edges: DataFrame, budget: int, max_depth: int, hops: int = 0) -> DataFrame:
    """(root, node, depth, place, exhausted): breadth-first from each root, ``budget`` nodes scheduled at most.

    starts: (root, node); edges: (src, dst, ordinal).  A node is scheduled once, in the order its
    callers were and then by ordinal; a search that schedules its whole budget counts as exhausted.
    Roots that have used their budget aren't searched further, and without ``hops``, for budgets up to ``CUT``, a node's edges are cut to its first ``budget``: of
    these as many lead to new nodes as the root may still schedule.
    With ``hops`` there is also ``path``: how the node was reached, the edges' ``via`` included, the last ``hops`` steps.
    """
    keep = ["path"] if hops else []
    first = [F.array(F.col("node").cast("string")).alias("path")] if hops else []
    seen = saved(starts.select("root", "node", F.lit(0).alias("depth"), F.lit(1).alias("place"), *first))
    used = saved(seen.groupBy("root").agg(F.max("place").alias("_used")))
    front = seen.join(used.where(F.col("_used") < budget), "root", "left_semi")
    if not hops and budget <= CUT:  # a root's several starts share the first place
        starting = starts.groupBy("root").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
        edges = first_edges(edges, budget + starting - 1)
    for depth in range(1, max_depth + 1):
        most = seen.count() + steps(front, edges)
        way = F.concat("path", F.array_compact(F.array("via", F.col("dst").cast("string")))) if hops else None
        longer = [F.slice(way, F.greatest(F.size(way) - hops + 1, F.lit(1)), hops).alias("path")] if hops else []
        step = front.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.col("place").alias("_from"), "ordinal", *longer)
        new = step.join(seen.select("root", "node"), ["root", "node"], "left_anti").groupBy("root", "node").agg(F.min(F.struct("_from", "ordinal", *keep)).alias("_o"))
        placed = new.join(used, "root").withColumn("place", (F.col("_used") + F.row_number().over(Window.partitionBy("root").orderBy("_o", "node"))).cast("int"))
        fresh = saved(placed.where(F.col("place") <= budget).select("root", "node", F.lit(depth).alias("depth"), "place", *[F.col(f"_o.{c}").alias(c) for c in keep]), rows=most)
        if fresh.isEmpty():
            break
        seen = seen.union(fresh)
        used = saved(seen.groupBy("root").agg(F.max("place").alias("_used")))
        front = fresh.join(used.where(F.col("_used") < budget), "root", "left_semi")
    full = used.select(F.col("root").alias("_root"), (F.col("_used") >= budget).alias("exhausted"))
    return seen.join(full, F.col("root").eqNullSafe(F.col("_root"))).drop("_root")


def steps(front: DataFrame, edges: DataFrame) -> int:
    """About how many steps lead on from ``front`` over edges (src, dst), by the mean of a node's edges."""
    n, nodes = edges.agg(F.count("*"), F.approx_count_distinct("src")).first()
    return front.count() * -(-n // max(nodes, 1)) + n


def first_edges(edges: DataFrame, most: int) -> DataFrame:
    """(src, dst, ordinal): of each node the ``most`` callers that come first, by ordinal and then by caller, each once."""
    own = edges.groupBy("src", "dst").agg(F.when(F.count("ordinal") == F.count("*"), F.min("ordinal")).alias("ordinal"))
    place = F.row_number().over(Window.partitionBy("src").orderBy("ordinal", "dst"))
    return saved(own.withColumn("_n", place).where(F.col("_n") <= most).select("src", "dst", "ordinal"))


def numbered(roots: DataFrame) -> DataFrame:
    """(root, word, bit) of distinct roots: 64 neighbours in order share a word.  Saved, so a retried task numbers nothing anew."""
    rows = roots.select("root").distinct().repartitionByRange("root").sortWithinPartitions("root").select("root", F.monotonically_increasing_id().alias("_n"))
    return saved(rows.select("root", F.shiftright("_n", 6).alias("word"), (F.col("_n") % 64).cast("int").alias("bit")))


def reach(starts: DataFrame, edges: DataFrame, budget: int, max_depth: int) -> DataFrame:
    """(root, node, depth, exhausted): what ``budgeted_search`` schedules, for many roots at once, without places.

    starts: (root, node); edges: (src, dst, ordinal).  64 roots travel as one word of bits: a level is a join of (node, word, bits) rows with the
    edges, an OR by node and word, and the bits not seen before.  New nodes are counted by root; a root that exceeds its budget
    leaves, and only those roots are searched in order, one row for each root and node, to tell which nodes come first.
    """
    numbers = numbered(starts)
    bit = F.expr("shiftleft(1L, bit)")
    front = saved(starts.distinct().join(numbers, "root").groupBy("node", "word").agg(F.bit_or(bit).alias("bits")).withColumn("depth", F.lit(0)))
    seen, counts = front, saved(_per_root(front, numbers).withColumnRenamed("n", "used"))
    ways = saved(edges.select("src", "dst").distinct(), rows=edges.count())
    for depth in range(1, max_depth + 1):
        most = seen.count() + steps(front, ways)
        alive = counts.join(numbers, ["word", "bit"]).where(F.col("used") < budget).groupBy("word").agg(F.bit_or(bit).alias("alive"))
        step = front.join(alive, "word").withColumn("bits", F.expr("bits & alive")).where("bits <> 0").join(ways, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
        before = seen.groupBy("node", "word").agg(F.bit_or("bits").alias("_seen"))
        front = saved(step.join(before, ["node", "word"], "left").select("node", "word", F.expr("bits & ~coalesce(_seen, 0L)").alias("bits"), F.lit(depth).alias("depth")).where("bits <> 0"), rows=most)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        counts = saved(counts.unionByName(_per_root(front, numbers).withColumnRenamed("n", "used")).groupBy("word", "bit").agg(F.sum("used").alias("used")))
    sizes = counts.join(numbers, ["word", "bit"]).select("root", "word", "bit", "used")
    over = saved(sizes.where(F.col("used") > budget).select("root"))
    whole = sizes.where(F.col("used") <= budget).join(seen, "word").where(F.expr("bits & shiftleft(1L, bit)") != 0).select("root", "node", "depth", (F.col("used") >= budget).alias("exhausted"))
    cut = budgeted_search(starts.join(over, "root", "left_semi"), edges, budget, max_depth).select("root", "node", "depth", "exhausted")
    return whole.unionByName(cut)


def reach_sums(starts: DataFrame, edges: DataFrame, max_depth: int, tile: int = TILE) -> DataFrame:
    """(root, n_nodes, steps, nodes): how many nodes lie within ``max_depth`` steps of each root, the sum of their depths, and their sum.

    starts: (root, node); edges: (src, dst), whole numbers.  All layers but the last are listed; of the last, which may have each root's
    neighbours' neighbours, only counts and sums leave a task.  A task has some of the roots, with what they reached so far, and all edges to some of
    the nodes, so it sees each new node of a root once; both are bounded by ``tile``, whatever the graph's size.  What is shuffled
    grows with the number of tiles, so these are large, and nodes are dealt by their remainder: a node's place in its tile needs no sorting.
    """
    ways = saved(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    seen = front = saved(starts.select("root", F.col("node").cast("long").alias("node"), F.lit(0).alias("depth")).distinct())
    for depth in range(1, max_depth):
        step = front.join(ways, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        front = saved(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.union(front)
    roots, n = seen.count(), ways.count()
    low, high = ways.agg(F.min("dst"), F.max("dst")).first() if n else (0, 0)
    by_node = -(-n // tile) or 1
    by_node += by_node > 1 and 1 - by_node % 2  # odd, as keys are often even
    by_root = max(-(-roots // tile), -(-2 * seen.sparkSession.sparkContext.defaultParallelism // by_node))  # tasks for all cores
    small = "int" if max(abs(low), abs(high)) < 2**30 and seen.where("abs(node) >= 1073741824").isEmpty() else "long"
    last, node = F.col("depth") == max_depth - 1, F.col("node").cast(small)
    mine = seen.groupBy("root").agg(F.collect_list(F.when(last, node)).alias("front"), F.collect_list(F.when(~last, node)).alias("before"))
    mine = mine.where(F.size("front") > 0).select("root", F.concat("front", "before").alias("near"), F.size("front").alias("n"), F.pmod(F.xxhash64("root"), F.lit(by_root)).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(by_node - 1).cast("long"))).alias("j"))
    chunks = -(-n // (by_node * CHUNK)) or 1
    to = ways.groupBy(F.col("src").cast(small).alias("src"), F.pmod("dst", F.lit(by_node)).alias("j")).agg(F.collect_list(F.col("dst").cast(small)).alias("dst"))
    to = to.groupBy(F.pmod(F.xxhash64("src"), F.lit(chunks)), "j").agg(F.collect_list(F.struct("src", "dst")).alias("_l"))
    to = to.select(F.col("_l.src").alias("src"), F.transform("_l.dst", F.size).alias("size"), F.flatten("_l.dst").alias("dst"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(by_root - 1).cast("long"))).alias("i"), "j")

    def count(roots: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        if not len(roots) or not len(targets):
            return pd.DataFrame({"root": roots["root"][:0], "n": [], "total": []})
        src, size, place = (np.concatenate(targets[c].to_numpy()) for c in ("src", "size", "dst"))
        del targets
        size, order = size.astype(np.int64), np.argsort(src)
        first = (np.cumsum(size) - size)[order]
        src, size = src[order], size[order]
        least, most = int(place.min()), int(place.max())
        names = None
        if (most - least) // by_node < 4 * len(place) + 1000 and most - least < np.iinfo(place.dtype).max:
            place -= place.dtype.type(least)
            place //= place.dtype.type(by_node)
            spots = (most - least) // by_node + 1
        else:
            names, place = np.unique(place, return_inverse=True)
            spots = len(names)
        stamp, out = np.zeros(spots, np.int64), []
        for near, n in zip(roots["near"], roots["n"], strict=True):
            k = np.minimum(np.searchsorted(src, near[:n]), len(src) - 1)
            k = k[src[k] == near[:n]]
            own = size[k]
            at = np.arange(own.sum())
            met = place[np.repeat(first[k] - (np.cumsum(own) - own), own) + at]
            stamp[met] = at  # of equal nodes one keeps its number
            if names is None:
                old, rest = np.divmod(near.astype(np.int64) - least, by_node)
                old = old[(rest == 0) & (old >= 0) & (old < spots)]
            else:
                old = np.minimum(np.searchsorted(names, near), spots - 1)
                old = old[names[old] == near]
            stamp[old] = -1
            new = met[stamp[met] == at]
            out.append((len(new), int(names[new].sum()) if names is not None else least * len(new) + by_node * int(new.sum(dtype=np.int64))))
        return pd.DataFrame({"root": roots["root"], "n": [x for x, _ in out], "total": [x for _, x in out]})

    kind = seen.schema["root"].dataType.simpleString()
    found = mine.groupBy("i", "j").cogroup(to.groupBy("i", "j")).applyInPandas(count, f"root {kind}, n long, total long")
    rows = seen.groupBy("root").agg(F.count("*").alias("n"), F.sum("depth").alias("d"), F.sum("node").alias("t"))
    if max_depth > 0:
        rows = rows.unionByName(found.groupBy("root").agg(F.sum("n").alias("n"), (F.sum("n") * max_depth).alias("d"), F.sum("total").alias("t")))
    return rows.groupBy("root").agg(F.sum("n").alias("n_nodes"), F.sum("d").alias("steps"), F.sum("t").alias("nodes"))


def _per_root(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """(word, bit, n): in how many rows each root's bit is set, added up 64 bits a word before the shuffle."""
    sums = rows.groupBy("word").agg(*[F.sum(F.expr(f"shiftrightunsigned(bits, {k}) & 1L")).alias(f"b{k}") for k in range(64)])
    return sums.select("word", F.posexplode(F.array(*[f"b{k}" for k in range(64)])).alias("bit", "n")).where("n > 0")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node that edges (a, b) reach.

    Large-star and small-star steps in turn, which settle in about log^2 n rounds on any graph.
    Each step is a grouped minimum and a join; the edges of a hub are dealt to several tasks.
    """
    edges = saved(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct())
    before = None
    state = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    now = state(edges)
    for _ in range(rounds):
        if now == before or not now["n"]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = heavy_join(both, low, "u", "v", 2 * now["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = heavy_join(large, floor, "u", "v", now["n"]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = saved(small.where("u <> v").distinct())
        before, now = now, state(edges)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def proven_edges(sites: DataFrame, by: list[str], code: str, proven: tuple[int, ...], ambiguous: int) -> DataFrame:
    """(by, code, proven): each edge's outcome over its call sites: the lowest proven code,
    else ambiguity, else the highest code."""
    is_proven = F.col(code).isin(*proven)
    best = F.min(F.when(is_proven, F.col(code)))
    unclear = F.max(F.col(code) == ambiguous)
    return sites.groupBy(*by).agg(first_match([(best.isNotNull(), best), (unclear, F.lit(ambiguous))], F.max(code)).alias("code"), best.isNotNull().alias("proven"))


def lineage(starts: DataFrame, edges: DataFrame, max_edges: int, max_depth: int) -> DataFrame:
    """(root, field, depth): fields that a value reaches over (source, target) edges, ``max_edges`` fields at most."""
    moves = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.lit(0).alias("ordinal")).distinct()
    found = budgeted_search(starts.select("root", F.col("field").alias("node")), moves, max_edges, max_depth)
    return found.select("root", F.col("node").alias("field"), "depth")


def cache_lineage(reached: DataFrame, writes: DataFrame, moves: DataFrame, max_depth: int, max_edges: int) -> DataFrame:
    """(root, source, target, place): the moves between fields that what a search reached sets off, ``max_edges`` of each root's
    at most, in the order of a queue; starting with the fields that cache a reached member's value.

    reached: (root, node, depth); writes: (node, field, owner), owner null or the method that writes, which must be reached one
    step further; moves: (source, target).  A field that is written and moves nowhere has one row without ``source``.
    """
    reached = saved(reached.select("root", "node", "depth"))
    near = reached.where(F.col("depth") <= max_depth).join(writes, "node").select("root", "field", "depth", "node", "owner")
    owners = reached.select("root", F.col("node").alias("owner"), F.col("depth").alias("_at"))
    owned = near.where("owner IS NOT NULL").join(owners, ["root", "owner"]).where(F.col("_at") == F.col("depth") + 1)
    held = near.where("owner IS NULL").select("root", "field", "depth", "node").union(owned.select("root", "field", "depth", "node"))
    first = held.groupBy("root", "field").agg(F.min(F.struct("depth", "node")).alias("_o"))
    front = saved(first.select("root", "field", F.row_number().over(Window.partitionBy("root").orderBy("_o", "field")).alias("at")), rows=reached.count())
    seen, found = front.select("root", "field"), [front.select("root", F.lit(None).cast(moves.schema["source"].dataType).alias("source"), F.col("field").alias("target"), F.lit(0).alias("place"))]
    used = front.select("root", F.lit(0).alias("used")).distinct()
    steps = moves.select("source", "target").distinct()
    while True:
        order = Window.partitionBy("root").orderBy("at", "target")
        rows = front.join(steps, F.col("field") == F.col("source")).join(used, "root")
        rows = saved(rows.withColumn("place", F.col("used") + F.row_number().over(order)).where(F.col("place") <= max_edges).select("root", "source", "target", "place"))
        if rows.isEmpty():
            break
        found.append(rows)
        fresh = rows.groupBy("root", F.col("target").alias("field")).agg(F.min("place").alias("at")).join(seen, ["root", "field"], "left_anti")
        front = saved(fresh.select("root", "field", "at"))
        seen = seen.union(front.select("root", "field"))
        used = saved(rows.groupBy("root").agg(F.max("place").alias("used")))
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def mixed(values: Column, none: str = "NONE") -> Column:
    """The only distinct non-null value of an array, MIXED for several, ``none`` for none."""
    kept = F.array_distinct(F.array_compact(values))
    return F.when(F.size(kept) == 0, F.lit(none)).when(F.size(kept) == 1, F.element_at(kept, 1)).otherwise(F.lit("MIXED"))


def link_kind(depth: Column, path: Column) -> Column:
    """DIRECT for a caller, CHAINED for one reached through others, DISPATCHED through an interface."""
    return first_match([(F.exists(path, lambda p: p.contains("#dispatch")), "DISPATCHED"), (depth <= 1, "DIRECT")], "CHAINED")


def dependencies(reached: DataFrame, nodes: DataFrame, roles: dict[str, Column], root: str = "root") -> DataFrame:
    """(root, one sorted array a role, status): names of reached nodes by role; a search that used up
    its budget is SUSPENDED and names nothing.

    reached: (root, node, exhausted); nodes: (node, name) and what the role conditions use.
    """
    reached = saved(reached.select(root, "node", "exhausted"))
    own = nodes.select("node", *[F.when(cond, F.col("name")).alias(role) for role, cond in roles.items()]).where(F.coalesce(*roles).isNotNull())
    sets = [F.array_sort(F.collect_set(role)).alias(role) for role in roles]
    sets = saved(reached.join(own, "node").groupBy(F.col(root).alias("_root")).agg(*sets), rows=reached.count())
    out = reached.groupBy(root).agg(F.max("exhausted").alias("_full")).join(sets, F.col(root).eqNullSafe(F.col("_root")), "left")
    none = F.array().cast("array<string>")
    out = out.select(root, "_full", *[F.coalesce(r, none).alias(r) for r in roles])
    named = [F.when(F.col("_full"), none).otherwise(F.col(r)).alias(r) for r in roles]
    some = F.greatest(*[F.size(r) for r in roles]) > 0 if len(roles) > 1 else F.size(next(iter(roles))) > 0
    return out.select(root, *named, first_match([(F.col("_full"), "SUSPENDED"), (some, "FOUND")], "NONE").alias("status"))


def relevant(records: DataFrame, consumers: DataFrame, key: str, max_depth: int = 2) -> DataFrame:
    """Records that have a consumer at most ``max_depth`` calls away."""
    return records.join(consumers.where(F.col("depth") <= max_depth).select(key), key, "left_semi")


def targeted_search(starts: DataFrame, edges: DataFrame, kinds: DataFrame, budgets: dict[str, int], max_depth: int) -> DataFrame:
    """(root, node, depth): a search that goes on from a node only while its kind's budget lasts.

    kinds: (node, kind) and maybe ``distance``, to the nearest endpoint.  In every layer each root's new nodes
    of a kind take that kind's places in order of their distance (unknown ones last) and of the node; kinds without
    a budget end the path (they are reached, not passed).
    """
    order = [F.asc_nulls_last("distance"), "node"] if "distance" in kinds.columns else ["node"]
    seen = saved(starts.select("root", "node", F.lit(0).alias("depth")))
    front, used, kinds = seen.select("root", "node"), None, kinds.where(F.col("kind").isin(*budgets))
    for depth in range(1, max_depth + 1):
        most = seen.count() + steps(front, edges)
        step = front.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        new = saved(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(depth).alias("depth")), rows=most)
        if new.isEmpty():
            break
        seen = seen.union(new)
        kind = new.join(kinds, "node").withColumn("_n", F.row_number().over(Window.partitionBy("root", "kind").orderBy(*order))).where(F.col("_n") <= max(budgets.values(), default=0))
        if used is not None:
            kind = kind.join(used, ["root", "kind"], "left")
        place = F.col("_n") + (F.coalesce("used", F.lit(0)) if used is not None else F.lit(0))
        limit = first_match([(F.col("kind") == k, F.lit(n)) for k, n in budgets.items()], F.lit(0))
        passed = saved(kind.where(place <= limit).select("root", "node", "kind"), rows=most)
        counts = passed.groupBy("root", "kind").agg(F.count("*").alias("used"))
        used = saved(counts if used is None else used.union(counts).groupBy("root", "kind").agg(F.sum("used").alias("used")))
        front = passed.select("root", "node")
    return seen
