"""Members that come in classes of equal ones: assigned class by class, the same as one by one."""

import random

import pytest
from ledgerwing.operators import matching
from ledgerwing.operators.assignment import Assignment


def test_classes_of_members_are_assigned_as_their_members_are():
    rng = random.Random(5)
    for _ in range(500):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        sizes = [rng.randint(1, 3) for _ in range(n)], [rng.randint(1, 3) for _ in range(m)]
        weight = {(a, b): rng.randint(0, rng.choice([3, 9, 40])) for a in range(n) for b in range(m) if rng.random() < 0.75}
        best = Assignment(n, m, [(a, b, w) for (a, b), w in weight.items()], *sizes)
        l, r = ([k for k, size in enumerate(own) for _ in range(size)] for own in sizes)
        full = {(i, j): weight[a, b] for i, a in enumerate(l) for j, b in enumerate(r) if (a, b) in weight}

        def total(edges, l=l, r=r):
            one = Assignment(len(l), len(r), [(i, j, w) for (i, j), w in edges.items()])
            return sum(edges[p] for p in one.pairs())

        assert sum(weight[a, b] * k for a, own in enumerate(best.places) for b, k in own.items()) == total(full)
        assert all(sum(own.values()) + best.free[0][a] == sizes[0][a] for a, own in enumerate(best.places))
        for (a, b), cost in best.margins(15).items():
            pair = l.index(a), r.index(b)
            assert cost == min(15, total(full) - total({p: w for p, w in full.items() if p != pair}))


@pytest.mark.parametrize("types", ["LARGE", "x LARGE"])
def test_global_assignment_pairs_classes(spark, types):
    """20,000 equal parts in a brand have 400 million pairs, and one class; sizes count where types differ."""
    from ledgerwing.plans import override_queries as oq

    rows = [(k, "red ring", "B1", "LARGE", k % 50) for k in range(20_000)] + [(-1, "old ring", "B2", "LARGE", 5), (-2, "old bolt", "B2", types, 5), (-3, "old bolt", "B3", "SMALL", 7)]
    got = oq._assigned(spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")).collect()
    by = {r["l_node"]: r for r in got}
    assert len(got) == len(by) == len({r["r_node"] for r in got}) == 20_003
    assert not any(by[k]["accepted"] or by[k]["score"] != 100 for k in range(20_000))
    assert all(by[k]["accepted"] and by[k]["r_node"] == k and by[k]["score"] == 100 for k in (-1, -2, -3))


def test_assign_classes_leaves_members_over(spark):
    scores = spark.createDataFrame([(0, 1, 7, 90), (0, 1, 8, 70), (0, 3, 8, 80)], "component long, l_rep long, r_rep long, score int")
    left = spark.createDataFrame([(1, 1), (1, 2), (1, 5), (3, 3)], "rep long, id long")
    right = spark.createDataFrame([(7, 7), (8, 8), (8, 9)], "rep long, id long")
    got = {r["l_node"]: (r["r_node"], r["score"]) for r in matching.assign_classes(scores, left, right).collect()}
    assert sorted(v for v in got.values() if v[0] is not None) == [(7, 90), (8, 70), (9, 80)] or sorted(v for v in got.values() if v[0] is not None) == [(7, 90), (8, 80), (9, 70)]
    assert len(got) == 4 and sum(v == (None, None) for v in got.values()) == 1 and got[3][1] == 80
