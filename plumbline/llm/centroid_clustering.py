"""Clustering around centroids with exponion search.

Every vector keeps an upper bound of the distance to its centroid and a lower bound of that to all others.  Where the
bounds cannot tell that the centroid is still the nearest one, only centroids within a ball around it are compared,
taken from its sorted list of the others by distance.  Vectors never move between tasks; centroids do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._storage import cut, table

DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
#: Components beyond that are an error: squared distances would not fit 64 bits.
MOST = 1 << 27
#: Numbers in the broadcast centroids, at most (distances between them included).
MOST_SHARED = 1 << 25
#: Bounds are rounded outwards by more than floating point can err.
_UP, _DOWN = 1 + 1e-9, 1 - 1e-9
_STATE = "vec_id long, x array<int>, cluster int, upper double, lower double"


@dataclass(frozen=True)
class Centroids:
    """Points, and for each one the others by ascending distance (at most, that is rounded down) and the nearest's (rounded down)."""

    points: np.ndarray
    order: np.ndarray
    gaps: np.ndarray
    near: np.ndarray

    @staticmethod
    def of(points: list[list[int]]) -> Centroids:
        p = np.array(points, np.int64)
        k = len(p)
        square = np.array([_squares(p, q) for q in p], np.float64)
        np.fill_diagonal(square, -1)  # first in its own list, and then left out
        order = np.argsort(square, axis=1, kind="stable")[:, 1:]
        gaps = np.sqrt(np.take_along_axis(square, order, axis=1)) * _DOWN
        return Centroids(p, order, gaps, gaps[:, 0] if k > 1 else np.full(1, np.inf))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer matrices, or of a matrix and a vector."""
    gap = x - y
    return np.einsum("ij,ij->i", gap, gap)


def search(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> None:
    """Give every row of ``x`` its nearest centroid, the smaller number of equally near ones; arrays change in place.

    The nearest centroid lies within 2 upper of the present one, the second nearest within 2 upper + near, so a ball of that
    radius, its surface included, holds both, and every centroid that ties with the nearest.
    """

    def doubtful(i: np.ndarray) -> np.ndarray:
        return i[upper[i] >= np.maximum(lower[i], c.near[cluster[i]] / 2)]

    rows = doubtful(np.arange(len(x)))
    own = _squares(x[rows], c.points[cluster[rows]])
    upper[rows] = np.sqrt(own) * _UP
    left = np.isin(rows, doubtful(rows))
    rows, own = rows[left], own[left]
    present = cluster[rows]
    for a in np.unique(present):
        mine = present == a
        i, best = rows[mine], own[mine]
        count = np.searchsorted(c.gaps[a], (2 * upper[i] + c.near[a]) * _UP, side="right")
        widest_first = np.argsort(-count, kind="stable")
        i, best, count = i[widest_first], best[widest_first], count[widest_first]
        name, second = np.full(len(i), a), np.full(len(i), np.inf)
        for t in range(count[0]):
            m = np.searchsorted(-count, -t, side="left")  # rows with more than t centroids in their ball
            j = c.order[a, t]
            square = _squares(x[i[:m]], c.points[j])
            better = (square < best[:m]) | ((square == best[:m]) & (j < name[:m]))
            second[:m] = np.where(better, best[:m], np.minimum(second[:m], square))
            best[:m] = np.where(better, square, best[:m])
            name[:m] = np.where(better, j, name[:m])
        cluster[i], upper[i], lower[i] = name, np.sqrt(best) * _UP, np.sqrt(second) * _DOWN


def _move(cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> None:
    """Widen the bounds by the distances that centroids have moved."""
    upper += moved[cluster]
    upper *= _UP
    most = np.full(len(moved), moved.max(initial=0.0))
    first = int(moved.argmax())
    most[first] = np.delete(moved, first).max(initial=0.0)
    lower -= most[cluster] * _UP
    lower *= np.where(lower > 0, _DOWN, _UP)


def _assign(state: DataFrame, c: Centroids, moved: np.ndarray, dimensions: int) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast((c, moved))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, far = shared.value
        for batch in batches:
            vec_id, points, *bounds = batch.columns
            x = points.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.int64)
            cluster, upper, lower = (b.to_numpy(zero_copy_only=False).copy() for b in bounds)
            _move(cluster, upper, lower, far)
            search(x, cluster, upper, lower, centroids)
            arrays = [vec_id, points, pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "x", "cluster", "upper", "lower"])

    return state.mapInArrow(nearest, _STATE)


def _means(state: DataFrame, dimensions: int, old: list[list[int]]) -> list[list[int]]:
    """Componentwise floor of the mean of every cluster's vectors; clusters without any stay.  Sums combine before the
    shuffle: one row per cluster and task."""
    sums = [F.sum(F.get("x", F.lit(d)).cast("long")).alias(f"s{d}") for d in range(dimensions)]
    new = list(old)
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        new[r["cluster"]] = [r[f"s{d}"] // r["n"] for d in range(dimensions)]
    return new


def cluster_vectors(vectors: DataFrame, start: list[list[int]], rounds: int = ROUNDS) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, x, cluster, distance`` (squared) of every row of ``vectors`` (``vec_id, x``), and the final centroids.

    ``x`` are arrays of equally many integers of at most ``MOST``, none null; ``start`` are the first centroids.  Each of ``rounds``
    assigns all vectors and moves the centroids to the floor of their vectors' mean; then all are assigned once more.  Equally
    near: the smaller number.  Empty clusters stay where they are.  Repeated rows and ids stay rows of their own.  Sums are
    exact for up to 2^36 rows.  What grows with the clusters (k * k + k * dimensions numbers) is broadcast; above ``MOST_SHARED``
    it is an error.
    """
    k, dimensions = len(start), len(start[0])
    if k * (k + dimensions) > MOST_SHARED:
        raise ValueError(f"{k} centroids of {dimensions} components are too many to broadcast")
    first = [F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower")]
    state = vectors.select("vec_id", "x", *first)
    points, moved = start, np.zeros(k)
    for _ in range(rounds):
        state = cut(_assign(state, Centroids.of(points), moved, dimensions))
        before, points = points, _means(state, dimensions, points)
        moved = np.sqrt(_squares(np.array(points, np.int64), np.array(before, np.int64))) * _UP
    state = cut(_assign(state, Centroids.of(points), moved, dimensions))
    point = F.get(F.array(*[F.array(*map(F.lit, p)) for p in points]), F.col("cluster"))
    gap = F.zip_with("x", point, lambda a, b: (a.cast("long") - b) * (a.cast("long") - b))
    distance = F.aggregate(gap, F.lit(0).cast("long"), lambda s, d: s + d)
    return state.select("vec_id", "x", "cluster", distance.alias("distance")), points


def whole_vectors(df: DataFrame, dimensions: int, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id, x``: rows whose vector has exactly ``dimensions`` components, all finite; x is floor(scale * component)."""
    finite: Column = F.forall(vector_col, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = df.where(F.col(vector_col).isNotNull() & (F.size(vector_col) == dimensions) & finite)
    whole = F.transform(vector_col, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")))
    fits = F.forall("x", lambda e: F.abs(e) <= MOST)
    checked = F.when(fits, F.col("x").cast("array<int>")).otherwise(
        F.raise_error(F.lit(f"a component times {scale} is beyond {MOST}")).cast("array<int>")
    )
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x")).select("vec_id", checked.alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors of least sha256 of seed and id, in that order; ids that repeat, by vector; null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [list(r["x"]) for r in vectors.orderBy(key.asc_nulls_last(), "x").limit(k).collect()]


def cluster(
    df: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = 64,
    seed: int = 1,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every whole vector.

    Rows whose vector is null, has another number of components, or one that is null or not finite are left out; a
    null id stays null.  With fewer vectors than ``k`` each starts a cluster; without any the result is empty.  Further columns are not
    read.  See ``cluster_vectors`` for ties, repeated rows and bounds.
    """
    vectors = whole_vectors(df, dimensions, id_col, vector_col, scale)
    start = first_centroids(vectors, k, seed)
    if not start:
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return df.sparkSession.createDataFrame([], empty)
    found, points = cluster_vectors(vectors, start, rounds)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    by_cluster = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        by_cluster([sums.get(j, 0) for j in range(len(points))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        by_cluster(digests).alias("centroid_sha256"),
    )


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _oracle(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same rounds, every vector against every centroid."""

    def assigned(r: int) -> str:
        return f"""a{r} AS (
  SELECT rid, k, d FROM (
    SELECT rid, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r}
  ) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1
)"""

    def moved(r: int) -> str:
        return f"""m{r} AS (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT k, i, sum(y)::BIGINT AS s, count(*) AS n
    FROM (SELECT k, unnest(x) AS y, unnest(range({DIMENSIONS})) AS i FROM a{r - 1} JOIN v USING (rid)) GROUP BY k, i)
  GROUP BY k
), c{r} AS (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{r - 1} c LEFT JOIN m{r} m USING (k))"""

    steps = [assigned(0)]
    for r in range(1, rounds + 1):
        steps += [moved(r), assigned(r)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND list_count(embedding) = {DIMENSIONS} AND NOT list_bool_or(
    list_transform(embedding, lambda e: isnan(e) OR isinf(e)))
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS k, x AS c FROM v QUALIFY k < {k}
), {", ".join(steps)}
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (rid) JOIN c{rounds} USING (k)
"""


ORACLE_SQL = _oracle()
