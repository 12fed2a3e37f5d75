"""Centroid clustering with an equal-average equal-variance search.

Vectors become integers, floor(scale * x). The first centroids are the vectors whose ids have the least hashes; each round assigns every
vector to its nearest centroid and moves the centroids to the floors of their vectors' means.

The nearest centroid is searched without measuring all distances. With S the sum of a vector's components and D its deviation (the
length of what is left when each component is lessened by the mean), the squared distance of x and c is at least
(S_x - S_c)^2 / dim + (D_x - D_c)^2. Centroids are sorted by their means; from a vector's own mean the scan goes outward to both sides, the nearer
one first, skips a centroid whose two terms together exceed the best distance so far, and ends where the first term alone does.
Bounds are rounded down, and what they leave is measured in whole numbers, so results are exact.

Tasks send sums for each centroid, never vectors; the driver holds ``k`` centroids. Each round reads the table once; rounds that lose an
executor are worked out anew for its files only.

Defined results: vectors that are null, of another length, or that hold a null or a component that isn't finite are left out. Repeated
rows count as often as they occur; of rows with equal ids the lesser vector comes first where the first centroids are chosen, and a null id comes last. With fewer
vectors than ``k`` each is a centroid. An empty table gives an empty result. Integers beyond 2 ** 27 would overflow distances and raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash

#: Distances of vectors within it fit into 64 bits, for up to 64 components.
FARTHEST = 1 << 27


def whole(batch: pa.RecordBatch, dim: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """The ids and integer vectors of a batch (id, array of doubles) that are kept."""
    full = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dim), False)
    ids, lists = batch.column(0).filter(full), batch.column(1).filter(full)
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    finite = np.isfinite(x).all(axis=1)
    v = np.floor(scale * x[finite])
    if v.size and np.abs(v).max() > FARTHEST:
        raise ValueError(f"a component is beyond {FARTHEST} after scaling")
    return ids.filter(pa.array(finite)), v.astype(np.int64)


def deviation(v: np.ndarray) -> np.ndarray:
    centred = v - v.mean(axis=1, keepdims=True)
    return np.sqrt(np.einsum("ij,ij->i", centred, centred))


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the number of its nearest centroid (ties: the smaller) and the squared distance."""
    (n, dim), k = v.shape, len(centroids)
    by_mean = np.argsort(centroids.sum(axis=1), kind="stable")
    sums, spread = centroids.sum(axis=1)[by_mean], deviation(centroids)[by_mean]
    own, own_spread = v.sum(axis=1), deviation(v)
    best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
    right = np.searchsorted(sums, own)
    left = right - 1
    rows = np.arange(n)
    far = np.iinfo(np.int64).max
    for _ in range(k):
        below = np.where(left[rows] >= 0, own[rows] - sums[np.maximum(left[rows], 0)], far)
        above = np.where(right[rows] < k, sums[np.minimum(right[rows], k - 1)] - own[rows], far)
        down = below <= above
        at = np.where(down, left[rows], right[rows])
        mean_part = np.minimum(below, above).astype(np.float64) ** 2 / dim * (1 - 1e-12)
        open_ = mean_part <= best[rows]  # farther means can't come nearer
        rows, at, mean_part, down = rows[open_], at[open_], mean_part[open_], down[open_]
        if not len(rows):
            break
        left[rows[down]] -= 1
        right[rows[~down]] += 1
        apart = np.abs(own_spread[rows] - spread[at]) - 1e-9 * (own_spread[rows] + spread[at] + 1)
        likely = mean_part + np.maximum(apart, 0) ** 2 * (1 - 1e-12) <= best[rows]
        near, which = rows[likely], by_mean[at[likely]]
        gap = v[near] - centroids[which]
        distance = np.einsum("ij,ij->i", gap, gap)
        better = (distance < best[near]) | ((distance == best[near]) & (which < number[near]))
        best[near[better]], number[near[better]] = distance[better], which[better]
    return number, best


def _first(vectors: DataFrame, k: int, dim: int, scale: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the least hashes; each task sends its own k at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: list[tuple] = []
        for batch in batches:
            ids, v = whole(batch, dim, scale)
            hashes = [(i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), j) for j, i in enumerate(ids.to_pylist())]
            cut = sorted(h[:2] for h in hashes)[:k][-1:]
            least = sorted(least + [(*h[:2], v[h[2]].tolist()) for h in hashes if h[:2] <= cut[0]])[:k]
        yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in least], pa.bool_()), pa.array([h[1] for h in least], pa.string()), pa.array([h[2] for h in least], pa.list_(pa.int64()))], ["no_id", "hash", "v"])

    rows = vectors.mapInArrow(run, "no_id boolean, hash string, v array<bigint>").orderBy("no_id", "hash", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, dim)


def _moved(vectors: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            _, v = whole(batch, dim, scale)
            if len(v):
                number, _ = nearest(v, centroids)
                order = np.argsort(number, kind="stable")
                has, starts = np.unique(number[order], return_index=True)
                sums[has] += np.add.reduceat(v[order], starts)
                counts += np.bincount(number, minlength=k)
        at = np.repeat(np.flatnonzero(counts), dim)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.tile(np.arange(dim), len(at) // dim)), pa.array(counts[at]), pa.array(sums[counts > 0].ravel())], ["cluster", "place", "n", "total"])

    parts = vectors.mapInArrow(run, "cluster long, place long, n long, total long")
    moved = centroids.copy()
    # decimals, since sums over all tasks may exceed 64 bits
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        moved[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return moved


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Per vector: id, cluster, distance (squared); and the final centroids."""
    narrow = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    centroids = _first(narrow, k, dim, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(narrow, centroids, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = whole(batch, dim, scale)
            if len(v):
                number, distance = nearest(v, centroids)
                yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    id_type = vectors.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {id_type}, cluster int, distance long").withColumnRenamed("id", id_col), centroids


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    found = stash(found)
    digests = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    summed = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    per_cluster = summed.crossJoin(F.broadcast(summed.agg(F.sum("cluster_inertia").alias("inertia")))).join(named, "cluster")  # k rows at the most
    return found.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5) -> str:
    """One common table expression for each round's assignment and its new centroids."""
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, vec_id) AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT CAST(rid - 1 AS INTEGER) AS cluster, e FROM v WHERE rid <= {k})",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""d{i} AS (SELECT v.rid, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i]))) AS distance FROM v CROSS JOIN c{i} c),
a{i} AS MATERIALIZED (SELECT rid, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) AS place FROM d{i}) WHERE place = 1)"""
        )
        if i < rounds:
            parts.append(
                f"""p{i} AS (SELECT a.cluster, place, sum(v.e[place]) AS s, count(*) AS n FROM a{i} a JOIN v USING (rid), unnest(range(1, 65)) AS r(place) GROUP BY a.cluster, place),
m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY place) AS e FROM p{i} GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m USING (cluster))"""
            )
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT v.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} c ON a.cluster = c.cluster
"""
    )


OP13_SQL = _sql()
