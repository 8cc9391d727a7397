"""Centroid clustering against SQL and plain integers, across all three ranges of magnitude."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from ledgerwing.llm import op11_clustering as op11

SF = "/root/testdata/sf0.001"


def plain(rows, k=op11.K, rounds=op11.ROUNDS, dims=op11.DIMS):
    """The contract in Python integers: {row number: (id, cluster, distance)} and the centroids."""
    whole = lambda x: int(x) * 64 if abs(x) >= 2**53 else math.floor(64 * x)
    held = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(held, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in held:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else old for j, old in enumerate(cents)]
    return [(i, near(v)[1], near(v)[0]) for i, v in held], cents


def test_clusters_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    df = op11.op11_clustering(spark, SF)
    names = sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(con.sql(f"SELECT {', '.join(names)} FROM ({op11.ORACLE_SQL})").fetchall())


@pytest.mark.parametrize("size", [0.5, 1e5, 1e9])
def test_clusters_plain(spark, size):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=op11.DIMS) * size).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(200)]  # copies of a few vectors
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, rows[9][1])]  # repeated and null ids
    rows += [(2000, None), (2001, []), (2002, [0.1] * 63), (2003, [0.1] * 65), (2004, [None] + [0.1] * 63), (2005, [math.nan] + [0.1] * 63), (2006, [math.inf] + [0.1] * 63), (2007, [-0.0] * 64)]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, cluster string, id int").repartition(5)
    got = op11.clusters(df, op11.fit(df)).collect()
    want, cents = plain(rows)
    fits = lambda v: v if v < 2**63 else None
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=key) == sorted(((i, j, fits(d)) for i, j, d in want), key=key)
    for r in got:
        own = [d for _, j, d in want if j == r["cluster"]]
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, cents[r["cluster"]])).encode()).hexdigest()
        assert r["cluster_inertia"] == fits(sum(own)) if all(d < 2**63 for d in own) else r["cluster_inertia"] is None


def test_clusters_mixed_magnitudes():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(20, 8)), rng.normal(size=(20, 8)) * 1e8, rng.normal(size=(5, 8)) * 1e300])
    x = op11.integers(x)
    cents = np.array([[int(v) for v in row] for row in x[[0, 1, 25, 26, 41]].tolist()], object)
    label, dist = op11.nearest(x, cents)
    for row, j, d in zip(x.tolist(), label, dist, strict=True):
        assert (d, j) == min((sum((int(a) - b) ** 2 for a, b in zip(row, c, strict=True)), n) for n, c in enumerate(cents.tolist()))
    assert op11.integers(np.array([[1e308, -1e308, 0.5]])).tolist() == [[int(1e308) * 64, -int(1e308) * 64, 32]]
    assert op11.integers(np.array([[-0.01, 0.01]])).tolist() == [[-1.0, 0.0]]


def test_clusters_few_and_none(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [1.0] * 64), (3, [2.0] * 64)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in op11.clusters(df, op11.fit(df)).collect()}
    assert {r["distance"] for r in got.values()} == {0} and got[1]["cluster"] == got[2]["cluster"] != got[3]["cluster"]
    none = df.where("vec_id > 9")
    assert len(op11.fit(none)) == 0 and op11.clusters(none, op11.fit(none)).count() == 0
