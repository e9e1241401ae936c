"""Operator 11, centroid clustering: Lloyd's rounds on distinct vectors with multiplicities.

Components become whole numbers, so vectors that agree in all of them are one vector with a multiplicity, found by a
grouping that adds up within tasks first: copies of one vector, however many, are a row a task. The rounds read the distinct
vectors alone, from a table in the shared folder. Each round is one narrow map, which assigns and adds up, and one row a
task and cluster that is shuffled; the centroids, k of them, are all that the driver and the tasks hold. Sums are whole
numbers, so results don't depend on how rows are dealt out. In the end assignments are joined back to the rows; a
vector that more than a thousandth of all rows share is broadcast for that, of which there are at most a thousand.

Vectors that are null, have another number of components than ``dims``, or any that is null or not finite, are left out.
Repeated rows and repeated ids are vectors of their own; a null id has no hash and is the last to start a cluster. Rows
whose ids' hashes are equal start clusters in order of their vectors. Fewer vectors than k make as many clusters. Ties go
to the smaller number. Further columns don't matter. An empty table, or one with no usable vector, gives no rows. Components
so large that a squared distance leaves 64 bits are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import Sums, distances, exactly, finite, floored, matrix, rejoined, summed


def _nearest(column: pa.Array, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of a batch, each one's centroid (the first of the nearest), and its distance."""
    whole = matrix(column, centroids.shape[1])
    d = distances(*exactly(whole, centroids))
    at = d.argmin(axis=1) if len(d) else np.zeros(0, np.int64)
    return whole, at, d[np.arange(len(at)), at].astype(np.int64)


def _round(distinct: DataFrame, centroids: np.ndarray) -> dict[tuple, tuple[int, list[int]]]:
    """Multiplicities and sums of the vectors nearest to each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(*centroids.shape)
        for batch in batches:
            whole, at, _ = _nearest(batch.column(0), centroids)
            sums.add(at, whole, batch.column(1).to_numpy(zero_copy_only=False))
        held = np.flatnonzero(sums.counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(sums.counts[held]), pa.array(list(sums.sums[held]), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    return summed(distinct.select("whole", "n").mapInArrow(run, "cluster int, n bigint, s array<bigint>"), ["cluster"], centroids.shape[1])


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector; and the centroids."""
    kept = vectors.select(key, vector).filter(finite(vector) & (F.size(vector) == dims)).select(key, floored(vector, scale).alias("whole"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    first = kept.select(digest.alias("h"), "whole").orderBy(F.asc_nulls_last("h"), "whole").limit(k).collect()
    if not first:
        return kept.selectExpr(f"`{key}`", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256").limit(0), []
    centroids = np.array([r["whole"] for r in first], np.int64)
    distinct = cut(kept.groupBy("whole").agg(F.count(F.lit(1)).alias("n")))
    for _ in range(rounds):
        for (c,), (n, s) in _round(distinct, centroids).items():
            centroids[c] = [x // n for x in s]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at, d = _nearest(batch.column(0), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at.astype(np.int32)), pa.array(d)], names=["whole", "n", "cluster", "distance"])

    assigned = cut(distinct.select("whole", "n").mapInArrow(run, "whole array<bigint>, n bigint, cluster int, distance bigint"))
    of = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)")).alias("d"), F.sum("n").alias("n")).collect()
    inertia, total = {r["cluster"]: int(r["d"]) for r in of}, sum(r["n"] for r in of)
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by_cluster = lambda values: F.get(F.array(*values), F.col("cluster"))
    out = rejoined(kept, assigned, "whole", "n", total).select(
        key, "cluster", "distance", by_cluster([F.lit(inertia.get(i, 0)).cast("bigint") for i in range(len(centroids))]).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), by_cluster(map(F.lit, named)).alias("centroid_sha256"),
    )
    return out, centroids.tolist()
