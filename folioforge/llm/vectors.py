"""What the vector operators share: vectors of whole numbers, exact distances and sums, joining groups back to their rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A value that more than one in so many rows share is broadcast, so at most this many are; no shuffled key holds more rows.
HEAVY = 1000


def finite(vector: str) -> Column:
    """Neither null nor with a component that is null, infinite or no number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def floored(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component x, taken as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a column of equally long integer arrays."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)


def exactly(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in the type that squared distances of their rows are exact in: doubles, which are faster, where these suffice."""
    most = max((int(np.abs(x).max()) for x in arrays if x.size), default=0)
    reach = max((x.shape[1] for x in arrays), default=1) * (2 * most) ** 2
    if reach >= 1 << 63 or most >= 1 << 62:
        raise OverflowError(f"components of up to {most} have distances beyond 64 bits")
    return [x.astype(np.float64 if reach < 1 << 53 else np.int64) for x in arrays]


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared Euclidean distance of each row of x to each entry, both as given by ``exactly``."""
    if x.dtype == np.float64:
        return np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ entries.T) + np.einsum("ij,ij->i", entries, entries)[None, :]
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


class Sums:
    """Counts and componentwise sums by group, exact in 64 bits."""

    def __init__(self, groups: int, width: int):
        self.counts, self.sums, self.reach = np.zeros(groups, np.int64), np.zeros((groups, width), np.int64), 0

    def add(self, group: np.ndarray, x: np.ndarray, weight: np.ndarray | None = None) -> None:
        if not len(group):
            return
        weight = np.ones(len(group), np.int64) if weight is None else weight
        self.reach += int(np.abs(x).max(initial=0)) * int(weight.sum())
        if self.reach >= 1 << 63:
            raise OverflowError("sums of components are beyond 64 bits within one task")
        order = np.argsort(group, kind="stable")
        held, at = np.unique(group[order], return_index=True)
        self.counts[held] += np.add.reduceat(weight[order], at)
        self.sums[held] += np.add.reduceat((x * weight[:, None])[order], at, axis=0)


def summed(parts: DataFrame, keys: list[str], width: int) -> dict[tuple, tuple[int, list[int]]]:
    """parts: keys, n, s (one row a task and group). n and s added up by keys, which are few by the caller's contract."""
    big = lambda x: F.sum(x.cast("decimal(20,0)"))
    rows = parts.groupBy(*keys).agg(big(F.col("n")).alias("n"), *(big(F.get("s", i)).alias(f"s{i}") for i in range(width))).collect()
    return {tuple(r[k] for k in keys): (int(r["n"]), [int(r[f"s{i}"]) for i in range(width)]) for r in rows}


def rejoined(rows: DataFrame, groups: DataFrame, on: str, count: str, total: int) -> DataFrame:
    """rows with the columns of their group; null is a value like any other.

    groups (a cut table) has one row for each value of ``on``; ``count`` says how many of the ``total`` rows have it. Rows of a
    heavy value meet it by broadcast, all others by a shuffle in which no key is heavy.
    """
    group = groups.withColumnRenamed(on, "__on").drop(count)
    is_heavy = F.col(count) * HEAVY > F.lit(total)
    heavy = F.broadcast(groups.filter(is_heavy).withColumnRenamed(on, "__on").drop(count))
    light = groups.filter(~is_heavy).withColumnRenamed(on, "__on").drop(count)
    same = F.col(on).eqNullSafe(F.col("__on"))
    met = rows.join(heavy, same)
    rest = rows.join(F.broadcast(heavy.select("__on")), same, "left_anti").join(light, same)
    return met.unionByName(rest).select(*rows.columns, *(c for c in group.columns if c != "__on"))
