"""The role resolver against a plain reading of each build, and edge budgets of cache lineage."""

import json
import random
from collections import defaultdict, deque

from ledgerwing.operators import graph, roles
from ledgerwing.plans import override_queries as oq

S = oq.ROLES
SCHEMA = "build long, ref string, owner string, name string, parameters array<string>, returns string, static boolean, runnable boolean, strings array<string>, invoked array<string>"


def plain(methods, made, known):
    """(roles, missing, status) of one build's distinct methods."""
    rows = list({m["ref"]: m for m in reversed(methods)}.values())
    has = lambda m, t: any(t in s for s in m["strings"])
    only = lambda own: own[0] if len(own) == 1 else None
    bare = lambda m: m["parameters"] == [] and m["returns"] == "V"
    pair = lambda m: not m["static"] and len(m["parameters"]) == 2 and m["parameters"][0] == S.argument and m["returns"] == "V"
    family = {r: [m for m in rows if has(m, t) and bare(m)] for r, t in S.family.items()}
    direct_all = [m for m in rows if has(m, S.direct[1]) and pair(m) and m["parameters"][1].startswith("L") and m["parameters"][1].endswith(";")]
    direct = only(direct_all)
    helpers = []
    for m in rows:
        if not m["static"] and m["parameters"] == [S.argument] and m["returns"] == "V":
            own = only([c for c in rows if pair(c) and c["owner"] == m["owner"] and c["ref"] in m["invoked"] and c["parameters"][1] in made and f"{c['parameters'][1]}-><init>()V" in m["invoked"]])
            if own and (not direct or (m["owner"] == direct["owner"] and own["ref"] == direct["ref"])):
                helpers.append((m, own))
    aux, delegate = only(helpers) or (None, None)
    owner = (direct or aux or {}).get("owner")
    factories = [m for m in rows if owner and m["owner"] == owner and m["static"] and m["parameters"] == [] and m["returns"] == owner]
    factory = only(factories)
    by_direct, by_aux = bool(direct and factory and direct["parameters"][1] in made), bool(aux and factory)
    activity = only([m for m in rows if factory and m["runnable"] and not m["static"] and m["name"] == "run" and bare(m) and {factory["ref"], *S.activity_calls} <= set(m["invoked"])])
    media = only([m for m in rows if has(m, S.media[1]) and m["parameters"] == [S.media_argument] and m["returns"] == "V"])
    got = {r: only(own)["ref"] for r, own in family.items() if only(own)}
    got |= {S.direct[0]: direct["ref"]} if by_direct else {}
    got |= {S.auxiliary: aux["ref"]} if by_aux else {}
    got |= {S.observer: direct["ref"] if by_direct else delegate["ref"]} if by_direct or by_aux else {}
    got |= {S.activity: activity["ref"]} if activity else {}
    got |= {S.factory: factory["ref"]} if factory else {}
    got |= {S.options: (direct or delegate)["parameters"][1] + "-><init>()V"} if by_direct or by_aux else {}
    got |= {S.media[0]: media["ref"]} if media else {}
    own = [only(f) for f in family.values()]
    n = oq.ROLE_LABELS
    missing = [name for ok, name in ((all(own) and len({m["owner"] for m in own}) == 1, n.family), (factory, n.factory), (by_direct or by_aux, n.route), (media, n.media)) if not ok]
    unclear = any(len(f) > 1 for f in family.values()) or (len(direct_all) > 1 and not by_aux) or (len(helpers) > 1 and not by_direct) or len(factories) > 1
    return got, missing, (n.ambiguous if unclear else n.unsupported) if missing else n.known if known else n.review


def test_role_resolver_against_plain(spark):
    rng = random.Random(21)
    rows, made = [], []
    for b in range(160):
        odd = rng.random
        made += [(b, o) for o in ("Lopt;", "Lalt;") if odd() < 0.9]
        here = []
        own = lambda: "Lc1;" if odd() < 0.9 else "Lc2;"  # noqa: E731, B023

        def add(owner, name, parameters, returns, static=False, runnable=False, strings=(), invoked=()):
            here.append((b, f"{owner}->{name}", owner, name if not runnable else "run", list(parameters), returns, static, runnable, list(strings), list(invoked)))  # noqa: B023

        for r, t in S.family.items():
            for k in range(rng.choices([0, 1, 2], [1, 14, 1])[0]):
                add(own(), f"{r}{k}", [], "V", strings=[f"x {t} y"])
        for k in range(rng.choices([0, 1, 2], [3, 8, 1])[0]):
            add(own(), f"direct{k}", [S.argument, rng.choice(["Lopt;", "Lopt;", "Lalt;", "I"])], "V", strings=[S.direct[1]])
        if odd() < 0.4:
            add("Lc1;", "plain", [S.argument, "Lopt;"], "V")
        for k in range(rng.choices([0, 1, 2], [3, 8, 1])[0]):
            add("Lc1;", f"helper{k}", [S.argument], "V", invoked=[x for x in ("Lc1;->direct0", "Lc1;->plain", "Lc2;->direct0", "Lopt;-><init>()V", "Lalt;-><init>()V") if odd() < 0.75])
        for k in range(rng.choices([0, 1, 2], [1, 14, 1])[0]):
            add("Lc1;", f"make{k}", [], "Lc1;", static=True)
        for k in range(rng.choices([0, 1, 2], [1, 6, 1])[0]):
            add("Lrun;", f"run{k}", [], "V", runnable=True, invoked=[x for x in ("Lc1;->make0", *S.activity_calls) if odd() < 0.95])
        for k in range(rng.choices([0, 1, 2], [1, 14, 1])[0]):
            add("Lm;", f"media{k}", [S.media_argument], "V", strings=[S.media[1]])
        rows += here + rng.sample(here, min(2, len(here)))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made_df = spark.createDataFrame(made, "build long, owner string")
    from pyspark.sql import functions as F

    got = {r["build"]: (dict(r["roles"]), list(r["missing"]), r["status"]) for r in roles.resolve_build(df, made_df, ["build"], S, oq.ROLE_LABELS, F.col("build") % 3 == 0).collect()}
    groups, types = defaultdict(list), defaultdict(set)
    for r in rows:
        groups[r[0]].append(dict(zip(SCHEMA.replace(",", "").split()[::2], r, strict=True)))
    for b, o in made:
        types[b].add(o)
    want = {b: plain(own, types[b], b % 3 == 0) for b, own in groups.items()}
    assert got == want and len({w[2] for w in want.values()}) == 4


def test_role_resolver_query(spark):
    d = "/root/testdata/sf0.001"
    groups = defaultdict(list)
    for r in oq._role_methods(spark, d).collect():
        groups[r["o_custkey"]].append(r.asDict())
    for r in oq.role_resolver(spark, d).collect():
        methods = {m["ref"]: m for m in groups[r["o_custkey"]]}.values()  # rows of one method differ in nothing but their number of copies
        want = plain(list(methods), {"Lopt;"} if r["o_custkey"] % 4 else set(), r["o_custkey"] % 3 == 0)
        assert (json.loads(r["roles"] or "{}"), [x for x in r["missing"].split(";") if x], r["status"]) == want


def test_cache_lineage_by_queue(spark):
    rng = random.Random(2)
    moves = sorted({(f"f{rng.randrange(12)}", f"f{rng.randrange(12)}") for _ in range(30)})
    writes = [(n, f"f{rng.randrange(12)}", rng.choice([None, None, 20, 21])) for n in range(6)]
    reached = [(r, n, rng.randint(0, 3)) for r in range(5) for n in rng.sample(range(6), 3)] + [(r, 20, rng.randint(0, 4)) for r in range(5)]
    for budget in (1, 3, 8, 500):
        got = defaultdict(list)
        frames = spark.createDataFrame(reached, "root long, node long, depth int"), spark.createDataFrame(writes, "node long, field string, owner long"), spark.createDataFrame(moves, "source string, target string")
        for r in graph.cache_lineage(*frames, 2, budget).collect():
            got[r["root"]].append((r["place"], r["source"], r["target"]))
        for root in range(5):
            depth = {n: at for r, n, at in reached if r == root}
            first = {}
            for n, field, owner in writes:
                if n in depth and depth[n] <= 2 and (owner is None or depth.get(owner) == depth[n] + 1):
                    first[field] = min(first.get(field, (9, 9)), (depth[n], n))
            start = sorted(first, key=lambda f: (first[f], f))
            queue, seen, edges = deque(start), set(start), []
            while queue and len(edges) < budget:
                at = queue.popleft()
                for s, t in moves:
                    if s == at and len(edges) < budget:
                        edges.append((len(edges) + 1, s, t))
                        if t not in seen:
                            seen.add(t)
                            queue.append(t)
            assert sorted(x for x in got[root] if x[1]) == edges and {x[2] for x in got[root] if not x[1]} == set(start)
