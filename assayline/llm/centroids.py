"""Exact centroid clustering of integer vectors by Shallot search.

Each vector remembers its nearest and second-nearest centroid with an upper bound of
the distance to the one and a lower bound of that to all others. After centroids
move, bounds alone tell for most vectors that nothing changes. The others are measured against both
remembered centroids; from the closer one, its neighbours are looked at in
ascending distance, within a ball that shrinks as the second-nearest gets nearer. Bounds
are floating-point numbers with a margin that only ever keeps a candidate more; what they leave is compared in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scratch import remove, scratch_path

#: Far above what rounding adds to a bound, relative to it.
_MARGIN = 1e-9
#: Integers are held within this, so that every squared distance of up to 128 components fits a long.
_MOST = 1 << 27
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class ShallotParams:
    """Vectors have ``dims`` components, each taken as ``floor(scale * x)``; ``seed`` picks the first centroids."""

    centroids: int = 16
    dims: int = 64
    rounds: int = 3
    scale: int = 64
    seed: str = "1"


def exact(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows, in integers."""
    apart = vectors.astype(np.int64) - centroids
    return np.einsum("ij,ij->i", apart, apart)


class Search:
    """What a pass knows of the centroids: for each, the others in ascending distance, and how far each has moved since the pass before."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None) -> None:
        self.centroids = centroids.astype(np.int64)
        k = len(centroids)
        apart = np.stack([np.sqrt(exact(self.centroids, np.broadcast_to(c, self.centroids.shape)).astype(float)) for c in self.centroids])
        order = np.argsort(apart, axis=1, kind="stable")
        self.order = np.stack([row[row != c] for c, row in enumerate(order)]) if k > 1 else np.zeros((k, 0), np.int64)
        self.gap = np.take_along_axis(apart, self.order, axis=1)
        self.half = self.gap[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if before is None else np.sqrt(exact(self.centroids, before.astype(np.int64)).astype(float))

    def assign(
        self, vectors: np.ndarray, cluster: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The four arrays after this pass; ties of nearest centroids go to the smaller number."""
        cluster, second = cluster.copy(), second.copy()
        upper = upper + self.moved[cluster]
        if len(self.centroids) > 1:
            far, next_far = np.argsort(self.moved)[::-1][:2]
            lower = lower - np.where(cluster == far, self.moved[next_far], self.moved[far])
        else:
            lower = np.full(len(upper), np.inf)

        def unsure(rows: np.ndarray) -> np.ndarray:
            certain = np.maximum(lower[rows], self.half[cluster[rows]])
            return rows[upper[rows] * (1 + _MARGIN) >= certain * (1 - _MARGIN)]

        rows = unsure(np.arange(len(vectors)))
        upper[rows] = np.sqrt(exact(vectors[rows], self.centroids[cluster[rows]]).astype(float))
        rows = unsure(rows)
        if not len(rows) or len(self.centroids) == 1:
            return cluster, second, upper, lower
        some, best, next_ = vectors[rows], cluster[rows], second[rows]
        d_best, d_next = exact(some, self.centroids[best]), exact(some, self.centroids[next_])
        closer = (d_next < d_best) | ((d_next == d_best) & (next_ < best))
        best, next_ = np.where(closer, next_, best), np.where(closer, best, next_)
        d_best, d_next = np.where(closer, d_next, d_best), np.where(closer, d_best, d_next)
        start, met = best.copy(), next_.copy()
        radius = np.sqrt(d_best.astype(float))
        active = np.arange(len(rows))
        for r in range(len(self.centroids) - 1):
            # A centroid farther from the start than both distances together is farther than the second-nearest.
            reach = (radius[active] + np.sqrt(d_next[active].astype(float))) * (1 + _MARGIN)
            active = active[self.gap[start[active], r] * (1 - _MARGIN) <= reach]
            if not len(active):
                break
            found = self.order[start[active], r]
            at, found = active[found != met[active]], found[found != met[active]]
            d = exact(some[at], self.centroids[found])
            nearest = (d < d_best[at]) | ((d == d_best[at]) & (found < best[at]))
            nearer = ~nearest & ((d < d_next[at]) | ((d == d_next[at]) & (found < next_[at])))
            won = at[nearest]
            next_[won], d_next[won] = best[won], d_best[won]
            best[won], d_best[won] = found[nearest], d[nearest]
            next_[at[nearer]], d_next[at[nearer]] = found[nearer], d[nearer]
        cluster[rows], second[rows] = best, next_
        upper[rows], lower[rows] = np.sqrt(d_best.astype(float)), np.sqrt(d_next.astype(float))
        return cluster, second, upper, lower


_STATE = "vec_id long, v array<int>, cluster int, second int, upper double, lower double"


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def integer_vectors(table: DataFrame, p: ShallotParams) -> DataFrame:
    """``(vec_id, v)`` of rows of ``table(vec_id, embedding)`` with exactly ``dims`` components, none null or non-finite.

    Components beyond 2^27 in size after scaling are taken as that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column("embedding")), p.dims).fill_null(False))
            # A null component becomes NaN.
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p.dims)
            good = np.isfinite(x).all(axis=1)
            whole = np.clip(np.floor(np.clip(p.scale * x[good], -2.0 * _MOST, 2.0 * _MOST)), -_MOST, _MOST).astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(len(whole) + 1, dtype=np.int32) * p.dims, pa.array(whole.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(good)), lists], ["vec_id", "v"])

    slim = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return slim.mapInArrow(run, "vec_id long, v array<int>")


def assigned(state: DataFrame, search: Search, p: ShallotParams, last: bool = False) -> DataFrame:
    """``state`` after one pass; ``last``: ``(vec_id, cluster, distance)`` instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), p.dims)
            held = [batch.column(c).to_numpy() for c in ("cluster", "second", "upper", "lower")]
            cluster, second, upper, lower = search.assign(v, *held)
            new = [pa.array(cluster, pa.int32()), pa.array(second, pa.int32()), pa.array(upper), pa.array(lower)]
            if last:
                distance = pa.array(exact(v, search.centroids[cluster]), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), new[0], distance], ["vec_id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), *new], batch.schema.names)

    return state.mapInArrow(run, "vec_id long, cluster int, distance long" if last else _STATE)


def first_centroids(vectors: DataFrame, p: ShallotParams) -> np.ndarray:
    """The vectors with the smallest hashes of ``seed:vec_id`` (a null id as nothing); a bounded top-k, whose rows alone reach the driver."""
    digest = F.sha2(F.concat(F.lit(p.seed + ":"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("digest"), "vec_id", "v").orderBy("digest", "vec_id", "v").limit(p.centroids).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, p.dims)


def next_centroids(state: DataFrame, centroids: np.ndarray, p: ShallotParams) -> np.ndarray:
    """Each centroid's vectors' floored mean; a row a centroid reaches the driver. An empty one stays."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("v")[i]) for i in range(p.dims)]).alias("sums"))
    out = centroids.copy()
    for r in sums.collect():
        out[r["cluster"]] = [total // r["n"] for total in r["sums"]]
    return out


def shallot(table: DataFrame, p: ShallotParams = ShallotParams()) -> tuple[DataFrame, list[list[int]]]:
    """``(vec_id, cluster, distance)`` of each kept vector, and the final centroids.

    After ``rounds`` rounds of assigning and moving, vectors are assigned once more; ``distance`` is squared. Each
    pass reads the vectors with their bounds where they lie and writes them to the shared folder, whence a lost task
    begins again; the pass before is then removed. Nothing is shuffled but a row of sums a task and centroid. The
    driver holds the centroids, whose number and size are parameters.

    Rows that aren't kept (null, too short or too long vectors, null or non-finite components) give no row. With fewer
    kept vectors than centroids there is a centroid for each. Repeated rows and null ids are vectors like others; ties
    of hashes are ordered by id and components. Other columns are ignored. An empty table gives an empty result.
    """
    spark = table.sparkSession
    path = scratch_path(spark, "vectors")
    integer_vectors(table, p).write.parquet(path)
    vectors = spark.read.schema("vec_id long, v array<int>").parquet(path)
    centroids = first_centroids(vectors, p)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    second = F.lit(min(1, len(centroids) - 1)).alias("second")
    state = vectors.select("vec_id", "v", F.lit(0).alias("cluster"), second, F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    before = None
    for _ in range(p.rounds):
        state, path = _passed(spark, assigned(state, Search(centroids, before), p), path, _STATE)
        before, centroids = centroids, next_centroids(state, centroids, p)
    done, _ = _passed(spark, assigned(state, Search(centroids, before), p, last=True), path, "vec_id long, cluster int, distance long")
    return done, centroids.tolist()


def _passed(spark: SparkSession, df: DataFrame, old: str, schema: str) -> tuple[DataFrame, str]:
    """``df`` written and read again, with its path; what it was made from, at ``old``, is removed."""
    path = scratch_path(spark, "vectors")
    df.write.parquet(path)
    remove(spark, old)
    return spark.read.schema(schema).parquet(path), path


def with_clusters(done: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Rows of ``shallot`` with ``cluster_inertia``, ``inertia`` (both at most 2^63 - 1) and ``centroid_sha256``; a row a centroid is broadcast."""
    spark = done.sparkSession
    sums = {r["cluster"]: int(r["total"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    whole = min(sum(sums.values()), _LONG)
    rows = [(c, min(sums.get(c, 0), _LONG), whole, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
