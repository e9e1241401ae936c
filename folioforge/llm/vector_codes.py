"""Operator 13, vector code compression: a codebook for each part of the vectors, searched by a kd-tree.

A vector is cut into equal parts; each part is replaced by the number of the nearest entry of its position's codebook. The
codebooks start as the parts of the vectors with the smallest ids. In each round a kd-tree of each codebook is broadcast
(its size is entries times width, whatever the data), tasks look their parts up by branch and bound, and one row a task, part
and entry carries counts and sums of whole numbers to the new entries. The search goes into a node also where its bound
equals the best distance so far, so that of equally near entries the one with the lowest index is found.

A search is made for a block of parts at once. Each part goes down to the leaf it falls into, for a first bound; then all
nodes are swept from the root, with those parts alone whose best distance reaches the node's box.

Vectors that are null, empty, or hold a component that is null or not finite, are left out, and so are vectors of another length
than most have (of two lengths as common, the longer one stays); that length must be a multiple of the number of parts.
Repeated rows and ids are vectors of their own; rows of one id start entries in order of their vectors, null ids come last.
Fewer vectors than entries make as many entries. Null labels count as one label. Further columns don't matter. An empty table, or one
without usable vectors, gives no rows. Components so large that a squared distance leaves 64 bits are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import Sums, distances, exactly, finite, floored, matrix, rejoined, summed

#: Entries of a leaf at most.
LEAF = 8
#: Parts that are searched at once.
BLOCK = 4096


@dataclass
class Node:
    """low, high: the box of its entries. A leaf has entries, others a dimension and value to go down by, and two children."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray | None = None
    dim: int = 0
    value: int = 0
    left: int = -1
    right: int = -1


class Tree:
    """A kd-tree over the entries of one codebook (whole numbers). visited: parts that met a leaf, of parts times leaves."""

    def __init__(self, codebook: np.ndarray):
        self.codebook, self.nodes, self.visited, self.most = codebook, [], 0, 0
        self._plant(np.arange(len(codebook)))
        self.leaves = sum(n.entries is not None for n in self.nodes)

    def _plant(self, which: np.ndarray) -> int:
        own = self.codebook[which]
        node, at = Node(own.min(axis=0), own.max(axis=0)), len(self.nodes)
        self.nodes.append(node)
        spread = node.high - node.low
        if len(which) <= LEAF or not spread.any():
            node.entries = np.sort(which)
            return at
        node.dim = int(spread.argmax())
        order = which[np.argsort(own[:, node.dim], kind="stable")]
        half = len(order) // 2
        node.value = int(self.codebook[order[half - 1], node.dim])
        node.left, node.right = self._plant(order[:half]), self._plant(order[half:])
        return at

    def search(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of whole numbers the nearest entry, the one of lowest index on a tie, and its squared distance."""
        code, best = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        for lo in range(0, len(parts), BLOCK):
            code[lo : lo + BLOCK], best[lo : lo + BLOCK] = self._search(parts[lo : lo + BLOCK])
        return code, best

    def _search(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, entries = exactly(parts, self.codebook)
        code, best, home = np.full(len(x), len(entries)), np.full(len(x), np.iinfo(np.int64).max, np.int64), np.zeros(len(x), np.int64)
        self.most += len(x) * self.leaves

        def look(node: Node, rows: np.ndarray) -> None:
            d = distances(x[rows], entries[node.entries])
            at = d.argmin(axis=1)  # entries of a leaf ascend, so this is the lowest index
            near, which = d[np.arange(len(rows)), at].astype(np.int64), node.entries[at]
            better = (near < best[rows]) | ((near == best[rows]) & (which < code[rows]))
            best[rows[better]], code[rows[better]] = near[better], which[better]
            self.visited += len(rows)

        down = [(0, np.arange(len(x)))]
        while down:
            at, rows = down.pop()
            node = self.nodes[at]
            if not len(rows):
                continue
            if node.entries is not None:
                home[rows] = at
                look(node, rows)
                continue
            left = x[rows, node.dim] <= node.value
            down += [(node.left, rows[left]), (node.right, rows[~left])]
        sweep = [(0, np.arange(len(x)))]
        while sweep:
            at, rows = sweep.pop()
            node = self.nodes[at]
            gap = np.maximum(np.maximum(node.low - x[rows], x[rows] - node.high), 0)
            rows = rows[(gap * gap).sum(axis=1) <= best[rows]]
            if node.entries is not None:
                rows = rows[home[rows] != at]
                if len(rows):
                    look(node, rows)
            elif len(rows):
                sweep += [(node.right, rows), (node.left, rows)]
        return code, best


def _looked_up(kept: DataFrame, trees, width: int, parts: int) -> dict[tuple, tuple[int, list[int]]]:
    """Counts and sums of the parts nearest to each entry, by part and entry."""
    size = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trees.value
        sums = [Sums(len(t.codebook), size) for t in own]
        for batch in batches:
            whole = matrix(batch.column(0), width)
            for p, tree in enumerate(own):
                part = whole[:, p * size : (p + 1) * size]
                sums[p].add(tree.search(part)[0], part)
        for p, s in enumerate(sums):
            held = np.flatnonzero(s.counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), p, np.int32)), pa.array(held.astype(np.int32)), pa.array(s.counts[held]), pa.array(list(s.sums[held]), pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])

    return summed(kept.select("whole").mapInArrow(run, "part int, entry int, n bigint, s array<bigint>"), ["part", "entry"], size)


def compress(vectors: DataFrame, entries: int = 256, rounds: int = 4, parts: int = 4, scale: int = 1024, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> tuple[DataFrame, list[list[list[int]]]]:
    """key, code (two hex digits a part), error, label_error, codebooks_sha256 of every usable vector; and the codebooks."""
    spark = vectors.sparkSession
    usable = vectors.select(key, label, vector).filter(finite(vector) & (F.size(vector) > 0))
    width = usable.groupBy(F.size(vector).alias("w")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "w"))["w"]).first()[0]
    kept = usable.filter(F.size(vector) == F.lit(width or 0)).select(key, label, floored(vector, scale).alias("whole"))
    if width is None:
        return kept.selectExpr(f"`{key}`", "'' as code", "0L as error", "0L as label_error", "'' as codebooks_sha256"), []
    if width % parts or not 1 <= entries <= 256:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts" if width % parts else "entries are numbered by two hex digits: 1 to 256")
    size = width // parts
    first = kept.select("whole", F.col(key).alias("at")).orderBy(F.asc_nulls_last("at"), "whole").limit(entries).collect()
    start = np.array([r["whole"] for r in first], np.int64)
    books = [start[:, p * size : (p + 1) * size].copy() for p in range(parts)]
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([Tree(b) for b in books])
        for (p, e), (n, s) in _looked_up(kept, trees, width, parts).items():
            books[p][e] = [v // n for v in s]
        trees.unpersist()
    trees = spark.sparkContext.broadcast([Tree(b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trees.value
        for batch in batches:
            whole = matrix(batch.column(2), width)
            found = [t.search(whole[:, p * size : (p + 1) * size]) for p, t in enumerate(own)]
            digits = np.stack([c for c, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            code = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            error = sum((d for _, d in found), np.zeros(len(whole), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error)], names=[key, label, "code", "error"])

    types = dict(kept.dtypes)
    coded = cut(kept.mapInArrow(run, f"`{key}` {types[key]}, `{label}` {types[label]}, code string, error bigint"))
    trees.unpersist()
    by_label = cut(coded.groupBy(label).agg(F.sum(F.col("error").cast("decimal(20,0)")).cast("bigint").alias("label_error"), F.count(F.lit(1)).alias("__n")))
    said = ",".join(str(v) for b in books for v in b.reshape(-1).tolist())
    out = rejoined(coded, by_label, label, "__n", coded.count())
    return out.select(key, "code", "error", "label_error", F.lit(hashlib.sha256(said.encode()).hexdigest()).alias("codebooks_sha256")), [b.tolist() for b in books]


def decoded(coded: DataFrame, books: list[list[list[int]]], scale: int = 1024, code: str = "code") -> DataFrame:
    """coded with ``vector``, what its code stands for."""
    if not books:
        return coded.withColumn("vector", F.array().cast("array<double>"))
    entry = lambda p, b: F.get(F.array(*(F.array(*(F.lit(float(v) / scale) for v in e)) for e in b)), F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int"))
    return coded.withColumn("vector", F.concat(*(entry(p, b) for p, b in enumerate(books))))
