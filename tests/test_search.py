"""Searches of many roots against a queue for each root."""

import random
from collections import defaultdict, deque

import pytest

from ledgerwing.operators import graph, resolve


@pytest.mark.parametrize("budget", [1, 3, 7, 40, 10_000])
def test_reach_equals_the_ordered_search(spark, budget):
    rng = random.Random(budget)
    edges = list({(rng.randrange(90), rng.randrange(90)) for _ in range(260)})
    df = spark.createDataFrame([(a, b, rng.randrange(5)) for a, b in edges], "src long, dst long, ordinal int")
    starts = spark.createDataFrame([(r, r % 90) for r in range(150)], "root long, node long")
    key = lambda rows: {(r["root"], r["node"], r["depth"], r["exhausted"]) for r in rows.collect()}
    assert key(graph.reach(starts, df, budget, 4)) == key(graph.budgeted_search(starts, df, budget, 4))


def test_reach_with_negative_bits(spark):
    """All 64 bits of a word count, the sign bit too."""
    starts = spark.createDataFrame([(r, 0) for r in range(64)], "root long, node long")
    got = graph.reach(starts, spark.createDataFrame([(0, 1, 0), (1, 2, 0)], "src long, dst long, ordinal int"), 99, 3).collect()
    assert {(r["root"], r["node"], r["depth"]) for r in got} == {(r, n, n) for r in range(64) for n in range(3)}


def test_full_roots_and_late_edges_are_left_alone(spark):
    """A hub's edges are cut to the budget (and the roots' further starts), whatever the order; the nodes are those of a queue."""
    edges = spark.createDataFrame([(0, k, -k) for k in range(1, 50)] + [(0, 49, 7)] + [(1, k, k) for k in (49, 48, 60)], "src long, dst long, ordinal int")
    assert graph.first_edges(edges, 3).where("src = 0").count() == 3
    got = graph.budgeted_search(spark.createDataFrame([(8, 0), (9, 0), (9, 49), (9, 48), (None, 0)], "root long, node long"), edges, 3, 2).collect()
    assert sorted(((r["root"], r["node"], r["depth"], r["place"], r["exhausted"]) for r in got), key=str) == [
        (8, 0, 0, 1, True), (8, 48, 1, 3, True), (8, 49, 1, 2, True), (9, 0, 0, 1, True), (9, 46, 1, 3, True), (9, 47, 1, 2, True), (9, 48, 0, 1, True), (9, 49, 0, 1, True), (None, 0, 0, 1, False)]


def one_root(start, edges, kinds, distance, b):
    """The queue of one root: (consumers, endpoint kinds, scheduled, corridor, fallback, facts)."""
    group = lambda x: kinds.get(x, (None, "generic"))[1]
    queue, scheduled, met = deque([(start, 0)]), [start], {}
    corridor = fallback = pruned = technical = unproven = 0
    corridor_full = fallback_full = False
    while queue:
        at, depth = queue.popleft()
        if depth >= b.depth:
            continue
        callers = sorted(edges[at])  # (ordinal, node, proven)

        def visit(x, follow, depth=depth):
            if follow:
                if x in scheduled or len(scheduled) >= b.nodes:
                    return
                scheduled.append(x)
                queue.append((x, depth + 1))
            met.setdefault(x, depth + 1)

        unproven += sum(not p and group(x) != "technical" for _, x, p in callers)
        for _, x, p in callers:
            if group(x) == "endpoint" and p:
                visit(x, False)
        for _, _, x in sorted((distance[x], o, x) for o, x, p in callers if p and x in distance and group(x) != "endpoint"):
            corridor += 1
            if corridor <= b.corridor:
                visit(x, True)
            else:
                corridor_full = True
        for kind, most in (("wrapper", b.wrapper), ("generic", b.generic)):
            n = 0
            for _, x, p in callers:
                if p and x not in distance and group(x) == kind:
                    n += 1
                    if n <= most and fallback < b.fallback:
                        fallback += 1
                        visit(x, True)
                    else:
                        pruned += 1
                        fallback_full |= fallback >= b.fallback
        n = 0
        for _, x, _p in callers:
            if group(x) == "technical":
                technical += 1
                n += 1
                if n <= b.technical:
                    visit(x, False)
    top = sorted(met, key=lambda x: (group(x) != "endpoint", met[x], x))[: b.retained]
    ends = sorted({kinds[x][0] for x in top if group(x) == "endpoint"})
    runtime = sum(group(x) not in ("technical", "wrapper") for x in top)
    if corridor_full or len(scheduled) >= b.nodes:
        reason = "SEMANTIC_CORRIDOR_EXHAUSTED"
    elif len(ends) > 1:
        reason = "MULTIPLE_SEMANTIC_ENDPOINTS"
    elif ends:
        reason = "SEMANTIC_ENDPOINT_FOUND"
    elif fallback_full:
        reason = "FALLBACK_BUDGET_EXHAUSTED"
    elif unproven and not runtime:
        reason = "VALUE_FLOW_NOT_PROVEN"
    elif pruned:
        reason = "SHARED_INFRASTRUCTURE_FANOUT"
    elif not runtime and technical:
        reason = "ONLY_TECHNICAL_CONSUMERS"
    else:
        reason = "GENERIC_RUNTIME_PATH_ONLY" if top else "NO_CONSUMER_FOUND"
    return top, ends, len(scheduled), fallback, reason


def distances(seeds, edges, most):
    callees = defaultdict(set)
    for src, own in edges.items():
        for _, x, _p in own:
            callees[x].add(src)
    out, front = dict.fromkeys(seeds, 0), set(seeds)
    for depth in range(1, most + 1):
        front = {y for x in front for y in callees[x]} - set(out)
        out |= dict.fromkeys(front, depth)
    return out


def held(got):
    return {r["root"]: (r["consumers"], r["endpoint_kinds"], r["scheduled"], r["fallback"], r["reason"]) for r in got}


@pytest.mark.parametrize("seed", range(4))
def test_resolve_against_queues(spark, seed):
    from ledgerwing.plans.graph_queries import search_outcome

    rng = random.Random(seed)
    n = 70
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([120, 300, 500]))}
    rows = [(a, c, rng.randrange(9), rng.random() < 0.7) for a, c in pairs]
    kinds = {x: (rng.choice("PQ"), rng.choices(["endpoint", "wrapper", "technical", "generic", "other"], [1, 4, 3, 6, 1])[0]) for x in range(n) if rng.random() < 0.9}
    b = resolve.Budgets(nodes=rng.choice([8, 20, 60]), corridor=rng.choice([3, 12, 99]), fallback=rng.choice([4, 9, 40]), wrapper=2, generic=3, technical=2, retained=5, depth=4, reach=rng.choice([1, 2, 5]))
    edges = defaultdict(list)
    for src, dst, o, p in rows:
        edges[src].append((o, dst, p))
    far = distances([x for x, (_, g) in kinds.items() if g == "endpoint"], edges, b.reach)
    want = {r: one_root(r, edges, kinds, far, b) for r in range(n)}
    got = resolve.resolve(
        spark.createDataFrame([(r, r) for r in range(n)], "root long, node long"), spark.createDataFrame(rows, "src long, dst long, ordinal int, proven boolean"),
        spark.createDataFrame([(x, c, g) for x, (c, g) in kinds.items()], "node long, category string, group string"), b, search_outcome).collect()
    assert held(got) == want
    assert len({w[-1] for w in want.values()}) > 1


def test_resolve_takes_all_parts(spark):
    from ledgerwing.plans import graph_queries as gq

    starts, rows, kinds = gq._resolve_inputs(spark, "/root/testdata/sf0.001")
    edges, named = defaultdict(list), {r["node"]: (r["category"], r["group"]) for r in kinds.collect()}
    for r in rows.collect():
        edges[r["src"]].append((r["ordinal"], r["dst"], r["proven"]))
    far = distances([x for x, (_, g) in named.items() if g == "endpoint"], edges, gq.BUDGETS.reach)
    got = held(resolve.resolve(starts, rows, kinds, gq.BUDGETS, gq.search_outcome).collect())
    assert got == {r["root"]: one_root(r["root"], edges, named, far, gq.BUDGETS) for r in starts.collect()}
