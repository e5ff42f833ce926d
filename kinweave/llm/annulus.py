"""Centroid clustering of integer vectors by annulus search: exact nearest centroids in exact rounds.

Centroids are sorted by norm. A vector's distances to the two centroids whose norms are next to its own bound its distance to the nearest one;
no centroid can be nearer whose norm differs from the vector's by more than that bound. Binary search finds the centroids with norms
inside this annulus, and squared distances to these alone are compared, in integers. Norms are compared with a margin above their rounding, so centroids
on the boundary, which may tie, are always among the candidates; ties go to the smaller number.

A round is one pass over the vectors: every task sends a count and a sum of components for each centroid, k rows, and the sums by (centroid, component)
that meet on the driver are k * dims numbers, whatever the input. Centroids go to the tasks as k * dims numbers as well.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are left out, and so are those with a component of 2**27 or
more after scaling, whose squared distances 64 bits can't hold. Rows that repeat an id are separate. A null id is never a first centroid. Fewer vectors than
centroids give as many centroids. Ties of the first centroids' hashes (repeated ids) go by components. Empty clusters keep their centroid. An inertia that 64 bits can't hold is null.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship, table

DIMS = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
LARGEST = 1 << 27
#: Rows that are compared at once.
CHUNK = 4096
POINTS = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def scaled(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, integers, of the vectors that take part."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    fits = lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) < LARGEST), F.lit(False))
    return vectors.where((F.size("embedding") == dims) & F.forall("embedding", fits)).select(F.col("vec_id").cast("long").alias("vec_id"), whole.cast("array<int>").alias("v"))


class Annulus:
    """Centroids by norm; nearest() answers exactly."""

    def __init__(self, centroids: np.ndarray):
        squares = (centroids * centroids).sum(1)
        self.number = np.lexsort((np.arange(len(centroids)), squares))
        self.centroids = centroids[self.number]
        self.norms = np.sqrt(squares[self.number].astype(np.float64))

    def _squared(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        apart = points - self.centroids[at]
        return np.einsum("ij,ij->i", apart, apart)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of the nearest centroid of each row of int64, and how many candidates were compared in all."""
        norms = np.sqrt(np.einsum("ij,ij->i", points, points).astype(np.float64))
        right = np.minimum(np.searchsorted(self.norms, norms), len(self.norms) - 1)
        left = np.maximum(right - 1, 0)
        bound = np.sqrt(np.minimum(self._squared(points, right), self._squared(points, left)).astype(np.float64))
        margin = 1e-9 * (norms + bound + 1)
        low = np.searchsorted(self.norms, norms - bound - margin, "left")
        high = np.searchsorted(self.norms, norms + bound + margin, "right")
        best, number = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(self.norms))
        for k in range(int((high - low).max(initial=0))):
            rows = np.flatnonzero(low + k < high)
            at = low[rows] + k
            apart = self._squared(points[rows], at)
            better = (apart < best[rows]) | ((apart == best[rows]) & (self.number[at] < number[rows]))
            best[rows[better]], number[rows[better]] = apart[better], self.number[at[better]]
        return number, best, int((high - low).sum())


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


def _chunks(batches, column: int):
    for batch in batches:
        for i in range(0, batch.num_rows, CHUNK):
            part = batch.slice(i, CHUNK)
            yield part, _matrix(part.column(column))


def _sums(batches, centroids: np.ndarray):
    """One row for each centroid that a task's vectors are nearest to: their number and the sums of their components."""
    index, n, sums = Annulus(centroids), np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
    for _, points in _chunks(batches, 0):
        number = index.nearest(points)[0]
        n += np.bincount(number, minlength=len(n))
        np.add.at(sums, number, points)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])


def _assigned(batches, centroids: np.ndarray):
    index = Annulus(centroids)
    for part, points in _chunks(batches, 1):
        number, apart, _ = index.nearest(points)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number.astype(np.int32)), pa.array(apart)], ["vec_id", "cluster", "distance"])


def refine(points: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after that many rounds over points (v)."""
    context = points.sparkSession.sparkContext
    for _ in range(rounds):
        sent = context.broadcast(centroids)
        parts = points.select("v").mapInArrow(lambda b, s=sent: _sums(b, s.value), "cluster int, n long, sums array<long>")
        # sums of many tasks may pass 64 bits; all is added exactly
        by = parts.select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
        centroids = centroids.copy()
        for r in by:
            centroids[r["cluster"], r["i"]] = int(r["x"]) // r["n"]
        sent.destroy()
    return centroids


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector; vectors has vec_id and embedding."""
    spark = ship(vectors.sparkSession)
    scratch = scratch or Scratch(spark, "annulus")
    points = scratch.keep(scaled(vectors), "points")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = points.where("vec_id is not null").withColumn("order", order).orderBy("order", "v").limit(k).collect()
    if not first:
        first = points.orderBy("v").limit(k).collect()  # no row has an id
    if not first:
        return spark.createDataFrame([], POINTS)
    centroids = refine(points, np.array([r["v"] for r in first], np.int64), rounds)
    sent = spark.sparkContext.broadcast(centroids)
    assigned = scratch.keep(points.mapInArrow(lambda b: _assigned(b, sent.value), "vec_id long, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    held = lambda x: x if x < 1 << 63 else None
    stats = [(c, held(d), held(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sums.items()]
    # a row for each centroid
    return assigned.join(F.broadcast(spark.createDataFrame(stats, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_clustering(spark, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _sql(rounds: int = ROUNDS) -> str:
    near = lambda i: f"""a{i} AS MATERIALIZED (SELECT id, v, cluster, d FROM (SELECT p.id, p.v, c.cluster, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d, row_number() OVER (PARTITION BY p.id ORDER BY d, c.cluster) AS r FROM p, c{i} c) WHERE r = 1),
"""  # noqa: E731
    mean = lambda i: f"""c{i} AS MATERIALIZED (SELECT o.cluster, coalesce(n.v, o.v) AS v FROM c{i - 1} o LEFT JOIN (SELECT cluster, list(m ORDER BY j) AS v FROM (SELECT cluster, j, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m FROM (SELECT cluster, unnest(range(64)) AS j, unnest(v) AS x FROM a{i - 1}) GROUP BY ALL) GROUP BY 1) n ON n.cluster = o.cluster),
"""  # noqa: E731
    steps = near(0) + "".join(mean(i) + near(i) for i in range(1, rounds + 1))
    return f"""
WITH p AS MATERIALIZED (
  SELECT vec_id AS id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h)::INT - 1 AS cluster, v FROM (SELECT sha256('3:' || id) AS h, v FROM p ORDER BY h LIMIT 8)),
{steps}s AS (SELECT cluster, sum(d)::BIGINT AS d FROM a{rounds} GROUP BY 1)
SELECT a.id AS vec_id, a.cluster::INT AS cluster, a.d AS distance, s.d AS cluster_inertia, (SELECT sum(d) FROM s)::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN s ON s.cluster = a.cluster JOIN c{rounds} c ON c.cluster = a.cluster
"""


OP12_SQL = _sql()
