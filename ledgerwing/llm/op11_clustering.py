"""Centroid clustering of integer vectors, exact in every sum and comparison.

Distances are |x|² - 2x·c + |c|²: one matrix product of a block of vectors with the centroids in
float64 BLAS.  All its terms are integers, so it is exact while they stay below 2^53; a row is
let into the product only if ``dims * (largest |x| + largest |c|)²`` does.  Other rows are compared as
64-bit integers, and beyond those as Python integers, so no size of component changes a result.

A round is a scan of the vectors alone: each task adds up counts and sums of its blocks (again a
product, with the matrix of assignments), and ``treeAggregate`` combines one small partial a task.
Only centroids, ``k * dims`` integers, reach driver and tasks.  Nothing is cached: a lost executor costs its running tasks.

Left out, by definition: null vectors, vectors of another length, and those with a null, NaN or
infinite component.  A null id is hashed as the empty text; repeated ids and rows all count, and equal hashes are
ordered by the components.  With fewer vectors than centroids there are as many centroids as vectors;
without any, the result is empty.  Ties go to the centroid with the smaller number.  A sum of distances that a
long can't hold comes back as null.  Other columns play no part.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stores import saved
from .common import tidy

DIMS, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, 1
BLOCK = 8192
_EXACT, _LONG = 1 << 53, 1 << 63


def kept(vector: str, dims: int = DIMS) -> Column:
    """Whether a vector has ``dims`` components, all finite."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return v.isNotNull() & (F.size(v) == dims) & ~bad


def vectors(df: DataFrame, vector: str, dims: int = DIMS, id_col: str | None = None) -> DataFrame:
    """(id, v): the kept vectors as doubles; without an id column v alone."""
    named = [F.col(f"`{vector}`").cast("array<double>").alias("v"), *([F.col(f"`{id_col}`").alias("id")] if id_col else [])]
    return df.select(*named).where(kept("v", dims))


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component: float64 where that is exact, else an array of Python integers.

    ``scale`` is a power of two, so the product of a double is exact unless it overflows.
    """
    if np.abs(values).max(initial=0.0) < _EXACT / scale:
        return np.floor(values * scale)
    whole = lambda x: int(x) * scale if abs(x) >= _EXACT else math.floor(x * scale)
    return np.array([[whole(x) for x in row] for row in values.tolist()], object).reshape(values.shape)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, and the squared distance as an object array of integers.

    ``x`` from ``integers``, ``centroids`` an object array of Python integers.
    """
    label, dist = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    if not len(x):
        return label, dist
    dims = x.shape[1]
    far = int(max(abs(c) for c in centroids.ravel().tolist()))
    own = np.abs(x).max(axis=1)
    reach = lambda limit: math.isqrt(limit // dims) - far  # noqa: E731 - a row's largest component, if limit is to hold
    product = (own < reach(_EXACT)).astype(bool)
    if product.any():
        a, c = np.ascontiguousarray(x[product], np.float64), centroids.astype(np.float64)
        d = a @ c.T
        d *= -2.0
        d += np.einsum("ij,ij->i", a, a)[:, None]
        d += np.einsum("ij,ij->i", c, c)[None, :]
        best = d.argmin(axis=1)
        label[product] = best
        dist[product] = d[np.arange(len(a)), best].astype(np.int64).tolist()
    longs = ~product & (own < reach(_LONG)).astype(bool)
    rest = ~product & ~longs
    for rows, kind in ((longs, np.int64), (rest, object)):
        if rows.any():
            a, c = x[rows].astype(np.int64) if kind is np.int64 else _whole(x[rows]), centroids.astype(kind)
            d = np.stack([((a - row) ** 2).sum(axis=1) for row in c], axis=1)
            best = np.array([r.index(min(r)) for r in d.tolist()])
            label[rows] = best
            dist[rows] = [int(v) for v in d[np.arange(len(a)), best]]
    return label, dist


def _whole(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def sums(x: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and component sums of each centroid, as Python integers."""
    count = np.bincount(label, minlength=k).astype(object)
    if x.dtype != object and np.abs(x).max(initial=0.0) * max(1, len(x)) < _EXACT:
        chosen = (label[None, :] == np.arange(k)[:, None]).astype(np.float64)
        return count, (chosen @ x).astype(np.int64).astype(object)
    x = _whole(x)
    total = np.zeros((k, x.shape[1]), object)
    for j in range(k):
        if count[j]:
            total[j] = x[label == j].sum(axis=0)
    return count, total


def _blocks(batches, dims: int, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches of at most ``BLOCK`` rows, with column ``at``'s vectors as a matrix."""
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            part = batch.slice(k, BLOCK)
            yield part, part.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def start(df: DataFrame, vector: str, id_col: str, k: int = K, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> np.ndarray:
    """The k kept vectors whose ids have the least hashes, in their order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = vectors(df, vector, dims, id_col).select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()  # k rows
    return _whole(integers(np.array([r["v"] for r in first], np.float64).reshape(-1, dims), scale))


def moved(df: DataFrame, centroids: np.ndarray, vector: str, scale: int = SCALE) -> np.ndarray:
    """One round: the centroids after every vector has gone to its nearest one."""
    k, dims = centroids.shape

    def partial(batches):
        count, total = np.zeros(k, object), np.zeros((k, dims), object)
        for _, values in _blocks(batches, dims, 0):
            x = integers(values, scale)
            c, t = sums(x, nearest(x, centroids)[0], k)
            count, total = count + c, total + t
        yield pa.record_batch([pa.array([pickle.dumps((count, total))], pa.binary())], names=["part"])

    parts = vectors(df, vector, dims).mapInArrow(tidy(partial), "part binary").rdd.map(lambda row: pickle.loads(row[0]))
    both = lambda a, b: (a[0] + b[0], a[1] + b[1])
    count, total = parts.treeAggregate((np.zeros(k, object), np.zeros((k, dims), object)), both, both)
    out = centroids.copy()
    for j in range(k):
        if count[j]:
            out[j] = total[j] // count[j]
    return out


def fit(df: DataFrame, vector: str = "embedding", id_col: str = "vec_id", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> np.ndarray:
    """The centroids after ``rounds`` rounds, an object array of integers."""
    centroids = start(df, vector, id_col, k, dims, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(df, centroids, vector, scale)
    return centroids


def assign(df: DataFrame, centroids: np.ndarray, vector: str = "embedding", id_col: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """(id, cluster, distance) of each kept vector; a distance beyond a long is null."""
    kind = df.schema[id_col].dataType.simpleString()
    _, dims = centroids.shape

    def run(batches):
        for part, values in _blocks(batches, dims, 0):
            label, dist = nearest(integers(values, scale), centroids)
            held = [d if d < _LONG else None for d in dist.tolist()]
            yield pa.record_batch([part.column(1), pa.array(label, pa.int32()), pa.array(held, pa.int64())], names=["id", "cluster", "distance"])

    rows = vectors(df, vector, dims, id_col)
    rows = rows if len(centroids) else rows.where("false")
    return rows.mapInArrow(tidy(run), f"id {kind}, cluster int, distance bigint").withColumnRenamed("id", id_col)


def clusters(df: DataFrame, centroids: np.ndarray, vector: str = "embedding", id_col: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """``assign`` with the distance summed over the vector's cluster and over all, and a digest of the centroid.

    The assignment, three numbers a vector, is saved; the sums are ``k`` rows at most, broadcast.
    """
    got = saved(assign(df, centroids, vector, id_col, scale))
    whole = lambda: F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(20,0)")))
    per = got.groupBy("cluster").agg(whole().alias("part"), F.count("*").alias("n")).collect()  # k rows at most
    total = None if any(r["part"] is None for r in per) else sum(int(r["part"]) for r in per)
    fits = lambda v: int(v) if v is not None and int(v) < _LONG else None
    names = [(r["cluster"], fits(r["part"]), fits(total), ",".join(map(str, centroids[r["cluster"]]))) for r in per]
    lookup = df.sparkSession.createDataFrame(names, "cluster int, cluster_inertia bigint, inertia bigint, centroid string").withColumn("centroid_sha256", F.sha2("centroid", 256)).drop("centroid")
    return got.join(F.broadcast(lookup), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return clusters(df, fit(df))


def _sql() -> str:
    """The same in SQL: a table of (vector, place, component), and each round as two steps."""
    steps = []
    for n in range(ROUNDS + 1):
        steps.append(f"""d{n} AS (SELECT x.r, c.j, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS dist FROM x JOIN c{n} c USING (i) GROUP BY x.r, c.j),
        a{n} AS (SELECT r, j, dist FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY dist, j) = 1)""")
        if n < ROUNDS:
            steps.append(f"""s{n} AS (SELECT a.j, x.i, sum(x.v)::BIGINT AS s, count(*) AS n FROM x JOIN a{n} a USING (r) GROUP BY a.j, x.i),
            c{n + 1} AS (SELECT c.j, c.i, CASE WHEN s.n IS NULL THEN c.v ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS v FROM c{n} c LEFT JOIN s{n} s USING (j, i))""")
    return f"""
    WITH k AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), embedding) AS r, vec_id, embedding FROM embeddings
        WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e::DOUBLE))) = 0),
    x AS (SELECT r, unnest(range({DIMS})) AS i, floor({SCALE} * unnest(embedding)::DOUBLE)::BIGINT AS v FROM k),
    c0 AS (SELECT (r - 1)::INT AS j, i, v FROM x WHERE r <= {K}),
    {", ".join(steps)},
    g AS (SELECT j, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY j)
    SELECT k.vec_id, a.j AS cluster, a.dist AS distance, (sum(a.dist) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(a.dist) OVER ())::BIGINT AS inertia, g.centroid_sha256
    FROM a{ROUNDS} a JOIN k USING (r) JOIN g USING (j)"""


ORACLE_SQL = _sql()
