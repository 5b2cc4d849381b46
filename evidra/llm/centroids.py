"""Centroid clustering in whole numbers: Lloyd's rounds, with Orchard's search for the nearest centroid.

Vectors of one length become whole numbers, floor(scale * x). For each centroid the others are listed by their distance from it.
A vector's search starts at the centroid that is nearest along the axis on which the centroids differ most and goes down that centroid's list: a
closer centroid becomes the current one and its list is taken up from the start; centroids seen before are passed over; the
search stops at the first centroid that lies strictly further from the current one than twice the vector's distance, as all
that follow are further from the vector than the current one is. Equally near centroids lie within that reach, so ties go to the
smaller number for sure. A batch of vectors goes through this together.

A round is one narrow pass: tasks put out one sum a component and cluster, Spark adds them up, and k * dim sums come back; k
and dim are parameters. Vectors are written once as whole numbers, and each round reads them. Distances and sums are exact: squares of
components up to LARGEST fit into 64 bits, larger ones fail rather than overflow; sums are decimals.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part and have no row; fewer
vectors than k: as many centroids; a null key is kept but starts no centroid before others do; rows with one key are vectors each of
their own; an empty table gives no rows; other columns, whatever their names, are not carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm.common import cut, drop, finite_vector, map_batches

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, 3
#: Largest magnitude of a component whose squared differences add up to less than 2^63 over DIM components.
LARGEST = 1 << 27
RUN = 4096

L, I = T.LongType(), T.IntegerType()
SUMS = T.StructType([T.StructField("cluster", I), T.StructField("i", I), T.StructField("s", L)])
PLACED = T.StructType([T.StructField("vec_id", L), T.StructField("cluster", I), T.StructField("distance", L)])


def whole(x: str, scale: int = SCALE) -> F.Column:
    """The vector in whole numbers; a component too large for exact distances is an error."""
    parts = F.transform(F.col(x).cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))))
    fits = F.forall(F.col(x).cast("array<double>"), lambda c: F.abs(c) * scale < LARGEST)
    return F.when(fits, parts).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} in whole numbers")).cast("array<bigint>"))


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others by distance (ties: smaller number first), and the squared distances in that order."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(apart, -1)
    order = np.argsort(apart, 1, kind="stable")[:, 1:]
    return order, np.take_along_axis(apart, order, 1)


class Orchard:
    """Finds the nearest centroid of many vectors at once; looked counts the distances computed."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.order, self.apart = neighbours(centroids)
        self.axis = int(np.argmax(centroids.max(0) - centroids.min(0)))
        self.along = np.argsort(centroids[:, self.axis], kind="stable")
        self.looked = 0

    def distance(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        self.looked += len(x)
        apart = x - self.centroids[to]
        return np.einsum("ij,ij->i", apart, apart)

    def start(self, x: np.ndarray) -> np.ndarray:
        """The centroid next along the axis."""
        sorted_ = self.centroids[self.along, self.axis]
        at = np.searchsorted(sorted_, x[:, self.axis]).clip(0, len(sorted_) - 1)
        before = (at - 1).clip(0)
        nearer = np.abs(sorted_[before] - x[:, self.axis]) <= np.abs(sorted_[at] - x[:, self.axis])
        return self.along[np.where(nearer, before, at)]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each vector's nearest centroid."""
        n, k = len(x), len(self.centroids)
        now = self.start(x)
        best = self.distance(x, now)
        seen = np.zeros((n, k), bool)
        seen[np.arange(n), now] = True
        place, open_ = np.zeros(n, np.int64), np.arange(n)
        while len(open_):
            open_ = open_[place[open_] < k - 1]
            # strictly beyond twice the distance; apart / 4 rounded up keeps the comparison within 64 bits
            open_ = open_[-(-self.apart[now[open_], place[open_]] // 4) <= best[open_]]
            to = self.order[now[open_], place[open_]]
            place[open_] += 1
            new = ~seen[open_, to]
            at, to = open_[new], to[new]
            seen[at, to] = True
            found = self.distance(x[at], to)
            closer = (found < best[at]) | ((found == best[at]) & (to < now[at]))
            at = at[closer]
            now[at], best[at], place[at] = to[closer], found[closer], 0
        return now, best


def matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.asarray(batch.column("v").flatten()).reshape(-1, dim)


def runs(batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, RUN):
            some = batch.slice(at, RUN)
            yield some, matrix(some, dim)


def kept_vectors(vectors: DataFrame, dim: int, scale: int, key: str, vector: str) -> DataFrame:
    """vec_id, v of the vectors that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("_v"))
    return rows.where((F.size("_v") == dim) & finite_vector("_v")).select("vec_id", whole("_v", scale).alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hashes of their keys, in order; k rows come back."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(mark.alias("mark"), "v").orderBy(F.col("mark").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floor of each cluster's mean; a cluster without vectors stays."""
    k, dim = centroids.shape
    shared = kept.sparkSession.sparkContext.broadcast(centroids)  # k * dim numbers

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        search = Orchard(shared.value)
        sums, n, count = np.zeros((k, dim + 1), np.int64), 0, 0
        out = lambda: {"cluster": np.repeat(np.arange(k, dtype=np.int32), dim + 1), "i": np.tile(np.arange(dim + 1, dtype=np.int32), k), "s": sums.ravel()}
        for _, x in runs(batches, dim):
            own, _ = search.nearest(x)
            by = np.argsort(own, kind="stable")
            at = np.flatnonzero(np.diff(own[by], prepend=-1))
            sums[own[by][at], :dim] += np.add.reduceat(x[by], at, 0)
            sums[:, dim] += np.bincount(own, minlength=k)
            n, count = n + len(x), count + 1
            if n > 1 << 34:  # sums of so many components may leave 64 bits
                yield out()
                sums, n = np.zeros((k, dim + 1), np.int64), 0
        if n:
            yield out()

    total = map_batches(kept.select("v"), SUMS, add).groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    shared.destroy()
    sums = {(r.cluster, r.i): int(r.s) for r in total}
    return np.array([[sums[c, i] // sums[c, dim] for i in range(dim)] if sums.get((c, dim)) else row for c, row in enumerate(centroids.tolist())], np.int64)


def sha256(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, key: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (squared) of each vector, as a table; and the centroids."""
    kept = cut(kept_vectors(vectors, dim, scale, key, vector), "whole")
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return cut(kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), "placed"), centroids
    for _ in range(rounds):
        after = moved(kept, centroids)
        if (after == centroids).all():
            break  # further rounds change nothing
        centroids = after
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # k * dim numbers

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        search = Orchard(shared.value)
        for some, x in runs(batches, dim):
            own, distance = search.nearest(x)
            yield {"vec_id": some.column("vec_id"), "cluster": own.astype(np.int32), "distance": distance}

    placed = cut(map_batches(kept, PLACED, place), "placed")
    drop(kept)
    return placed, centroids


def with_inertia(placed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """placed with cluster_inertia, inertia (distances summed over the cluster, and over all) and centroid_sha256 (of the
    centroid's components, joined by commas). A row for each cluster is gathered."""
    sums = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    of = [F.struct(F.lit(sums.get(c, 0)).cast("long").alias("own"), F.lit(sha256(row)).alias("sha")) for c, row in enumerate(centroids.tolist())]
    found = F.get(F.array(*of), F.col("cluster")) if of else F.struct(F.lit(0).cast("long").alias("own"), F.lit("").alias("sha"))
    return placed.withColumn("_of", found).select(
        "vec_id", "cluster", "distance", F.col("_of.own").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), F.col("_of.sha").alias("centroid_sha256")
    )


def sql(k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> str:
    """The same in DuckDB: every vector against every centroid, a table for each round."""
    square = "CAST(list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT rid, arg_min(number, (d, number)) AS cluster, min(d) AS d FROM (SELECT rid, c.number, {square} AS d FROM v, c{r} c) q GROUP BY rid)"
        )
        if r < rounds:
            mean = "(s - ((s % n) + n) % n) // n"
            steps.append(f"""s{r} AS MATERIALIZED (
  SELECT cluster, i, sum(CAST(v.v[i] AS HUGEINT)) AS s, count(*) AS n FROM v JOIN a{r} USING (rid), unnest(range(1, {dim + 1})) t(i) GROUP BY cluster, i),
c{r + 1} AS MATERIALIZED (
  SELECT number, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT cluster, list(CAST({mean} AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY cluster) m ON m.cluster = c.number)""")
    last = rounds
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY mark, v) - 1 AS INTEGER) AS number, v FROM (SELECT sha256('{seed}:' || vec_id) AS mark, v FROM v ORDER BY mark NULLS LAST, v LIMIT {k}) q),
{(","+chr(10)).join(steps)},
t AS (SELECT cluster, CAST(sum(d) AS BIGINT) AS own FROM a{last} GROUP BY cluster)
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, d AS distance, own AS cluster_inertia, CAST((SELECT sum(own) FROM t) AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM a{last} a JOIN v USING (rid) JOIN t ON t.cluster = a.cluster JOIN c{last} c ON c.number = a.cluster
"""
