"""k-means on whole numbers, with Ptolemaic pivots.

For any four points of a Euclidean space, d(x,c) * d(p,s) >= |d(x,p) * d(c,s) - d(x,s) * d(c,p)| (Ptolemy).
The distances of every vector from a few fixed pivots are computed once and stored with it; those of the
centroids are computed each round. Every pair of pivots then gives a lower bound of the distance between a
vector and a centroid without touching their components. The centroid with the least bound is compared
exactly; of the others only those whose bound does not exceed that distance. Bounds are rounded down by far
more than their floating-point error, comparison is strict, and what survives is compared in integers with
ties to the smaller number, so the assignment is that of plain comparison.

Each round is one pass over the stored vectors: a partition adds up counts and sums by centroid and sends
one row for each; the driver holds k centroids, nothing else.

Defined results: vectors that are null, of another size, or hold a null, NaN or infinity take no part and
are not returned; a null id takes part but is no first centroid unless ids run out; repeated ids are vectors
each (as first centroids in the order of their components); with fewer than k vectors there are fewer
centroids; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmill.llm.common import checkpointed
from sheetmill.llm.integer_vectors import LONGEST, Sums, finite, floored, longs, matrix, moved, slices, squared, sums_schema, whole

PIVOTS, SLACK = 6, 1e-9


class Ptolemy:
    """Centroids and pivots of one round."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.centroids, self.pivots = centroids, pivots
        self.to_pivots = np.sqrt(np.stack([squared(centroids, p[None, :]) for p in pivots], axis=1).astype(np.float64))
        between = np.sqrt(np.stack([squared(pivots, p[None, :]) for p in pivots], axis=1).astype(np.float64))
        self.pairs = [(i, j, between[i, j]) for i, j in combinations(range(len(pivots)), 2) if between[i, j] > 0]

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances (vectors by centroids) from the vectors' pivot distances."""
        c = self.to_pivots
        low = np.zeros((len(x), len(c)))
        for i, j, apart in self.pairs:
            one, two = x[:, i, None] * c[None, :, j], x[:, j, None] * c[None, :, i]
            np.maximum(low, (np.abs(one - two) - SLACK * (one + two)) / (apart * (1 + SLACK)), out=low)
        # A single pivot bounds by the triangle inequality, which needs no pair of different pivots.
        for i in range(c.shape[1]):
            np.maximum(low, np.abs(x[:, i, None] - c[None, :, i]) - SLACK * (x[:, i, None] + c[None, :, i]), out=low)
        return low * low * (1 - SLACK)

    def nearest(self, vectors: np.ndarray, pivot_squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector, its squared distance, and how many distances were computed."""
        low = self.bounds(np.sqrt(pivot_squares.astype(np.float64)))
        rows = np.arange(len(vectors))
        best = low.argmin(axis=1)
        d2 = squared(vectors, self.centroids[best])
        # Bounds are below the true distances; a float may round an exact distance down by a part in 2^53, so SLACK covers it.
        open_ = low <= d2.astype(np.float64)[:, None] * (1 + SLACK)
        open_[rows, best] = False
        counted = len(vectors) + int(open_.sum())
        for k in np.flatnonzero(open_.any(axis=0)):
            at = np.flatnonzero(open_[:, k])
            d = squared(vectors[at], self.centroids[k][None, :])
            closer = (d < d2[at]) | ((d == d2[at]) & (k < best[at]))
            best[at[closer]], d2[at[closer]] = k, d[closer]
        return best, d2, counted


def kept_vectors(vectors: DataFrame, scale: int, dim: int, vec_id: str, vector: str) -> DataFrame:
    rows = vectors.select(vectors[vec_id].alias("vec_id"), vectors[vector].alias("raw"))
    return rows.where(F.col("raw").isNotNull() & (F.size("raw") == dim) & finite(F.col("raw"))).select("vec_id", floored(F.col("raw"), scale).alias("v"))


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, dim: int = 64, prefix: str = "2:", vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every kept vector, and the final centroids (k rows at most)."""
    kept = kept_vectors(vectors, scale, dim, vec_id, vector)
    order = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    if not first:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, dim), dtype=np.int64)
    centroids = whole([r["v"] for r in first])
    pivots = spread_out(centroids)

    def cached(batches):
        for batch in slices(batches):
            v = matrix(batch.column("v"), dim)
            far = np.stack([squared(v, p[None, :]) for p in pivots], axis=1)
            to = pa.array(far.astype(np.float64).ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, far.size + 1, far.shape[1], dtype=np.int32)), to)], names=["vec_id", "v", "to_pivots"])

    id_type = dict(kept.dtypes)["vec_id"]
    stored = checkpointed(kept.mapInArrow(cached, f"vec_id {id_type}, v array<long>, to_pivots array<double>"), 10_000)
    for _ in range(rounds):
        centroids = moved(centroids, sums(stored, Ptolemy(centroids, pivots), dim))
    final = Ptolemy(centroids, pivots)

    def assigned(batches):
        for batch in slices(batches):
            best, d2, _ = final.nearest(matrix(batch.column("v"), dim), pivot_matrix(batch, len(pivots)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best.astype(np.int32)), longs(d2)], names=["vec_id", "cluster", "distance"])

    return stored.mapInArrow(assigned, f"vec_id {id_type}, cluster int, distance long"), centroids


def pivot_matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return batch.column("to_pivots").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n)


def sums(stored: DataFrame, state: Ptolemy, dim: int) -> DataFrame:
    """Counts and sums by nearest centroid, one row for each partition and centroid."""

    def run(batches):
        added = Sums(len(state.centroids), dim)
        for batch in slices(batches):
            v = matrix(batch.column("v"), dim)
            added.add(state.nearest(v, pivot_matrix(batch, len(state.pivots)))[0], v)
        yield added.batch()

    return stored.select("v", "to_pivots").mapInArrow(run, sums_schema(dim))


def spread_out(points: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to ``n`` different points, each the furthest from those before it."""
    chosen = [0]
    near = squared(points, points[:1])
    while len(chosen) < min(n, len(points)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squared(points, points[chosen[-1]][None, :]))
    return points[chosen]


def report(vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, dim: int = 64, prefix: str = "2:") -> DataFrame:
    """``vec_id, cluster, distance`` with the sums of distances by cluster and over all, and a hash of the centroid."""
    found, centroids = clustered(vectors, k, rounds, scale, dim, prefix)
    found = checkpointed(found, 10_000)
    hashes = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    # One row for each cluster: at most k.
    by = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(total.alias("s")).collect()}
    rows = [(c, min(by.get(c, 0), LONGEST), min(sum(by.values()), LONGEST), h) for c, h in enumerate(hashes)]
    figures = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def twin(k: int = 40, rounds: int = 5, scale: int = 256, dim: int = 64, prefix: str = "2:", table: str = "embeddings") -> str:
    """The same report in DuckDB SQL: every vector with every centroid, round by round."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM {table}
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INTEGER) AS cluster, v AS c
  FROM (SELECT sha256('{prefix}' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept) QUALIFY row_number() OVER (ORDER BY h NULLS LAST, v) <= {k})""",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (
  SELECT n, min(struct_pack(d := d, cluster := cluster)) AS best
  FROM (SELECT n, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM kept, c{i}) GROUP BY n)"""
        )
        if i < rounds:
            parts.append(
                f"""m{i} AS MATERIALIZED (
  SELECT cluster, list(CAST(floor_div AS BIGINT) ORDER BY pos) AS c FROM (
    SELECT cluster, pos, CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS floor_div FROM (
      SELECT best.cluster AS cluster, pos, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n
      FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM kept JOIN a{i} USING (n)) GROUP BY ALL)) GROUP BY cluster)"""
            )
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))")
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, best.cluster AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} USING (n) JOIN c{rounds} ON cluster = best.cluster"""
    )
