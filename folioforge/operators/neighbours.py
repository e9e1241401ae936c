"""Nearest vectors of a large query set as a distributed join, exact, by pivots and triangle bounds.

Rows are dealt to the cell of the nearest of a bounded number of pivots; of a cell only its size and radius (the greatest
angle to its pivot) come to the driver. Each query first meets the cells around it that hold k rows; the k-th similarity found
there is fed forward: of all other cells it meets those that a nearer row may lie in, as angles obey the triangle inequality.
Rows of a cell and queries that meet it are joined in blocks of bounded size, so neither a crowded cell nor a popular one
burdens a task; the best k of a block are what leaves it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut
from .audit import best_rows

#: Pivots at most; rows and queries of a block; rows that a block's queries are compared with at once.
PIVOTS, ROWS, QUERIES, TILE = 1024, 4096, 4096, 512
#: Rows of a batch that are held against all pivots at once; rows that a batch of queries and cells has at most, but for a query's own.
SLICE, TOLD = 512, 16_384
#: Angles and similarities (of six places) are compared with this much to spare.
SLACK = 2e-6
#: Cell of zero vectors, whose similarity to all others is 0.
ZERO = -1


def unit(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero ones stay) of the rows of that width without null or infinite components, and which rows those are."""
    import pyarrow.compute as pc

    fit = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    some = np.flatnonzero(fit.to_numpy(zero_copy_only=False))
    x = pc.cast(column.filter(fit).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    good = np.isfinite(x).all(axis=1)
    x, some = x[good], some[good]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), some


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, SLICE at most in a batch: what is made of a row may be as large as all pivots."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            yield batch.slice(lo, SLICE)


def told(ids: pa.Array, x: np.ndarray, of: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """query_id, x, cell: a row for each cell of each query, TOLD or one query's in a batch. A query may meet all cells, each time
    with its vector."""
    ends = np.cumsum([len(c) for c in of])
    lo = 0
    while lo < len(of):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOLD, side="right")))
        at = pa.array(np.repeat(np.arange(lo, hi), [len(c) for c in of[lo:hi]]))
        said = pa.array([v.tobytes() for v in x[lo:hi]], pa.binary())
        yield pa.RecordBatch.from_arrays([ids.take(at), said.take(pa.array(at.to_numpy() - lo)), pa.array(np.concatenate(of[lo:hi]).astype(np.int32))], names=["query_id", "x", "cell"])
        lo = hi


def best(ids: np.ndarray, x: np.ndarray, own: np.ndarray, y: np.ndarray, k: int, tile: int = TILE) -> pa.RecordBatch:
    """query_id, neighbour_id, sim: the k rows (own, y) of greatest similarity (six places; ties by id) to each query, itself left out."""
    s, o = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
    for lo in range(0, len(own), tile):
        these = own[lo : lo + tile]
        sims = np.round(x @ y[lo : lo + tile].T, 6) + 0.0
        sims[ids[:, None] == these[None, :]] = -2.0
        s, o = np.hstack((s, sims)), np.hstack((o, np.broadcast_to(these, sims.shape)))
        if s.shape[1] > 4 * k:  # those that may be among the k best, all ties of the last one included
            least = np.partition(s, -k, axis=1)[:, -k]
            some = max(k, int((s >= least[:, None]).sum(axis=1).max()))
            near = np.argpartition(-s, min(some, s.shape[1]) - 1, axis=1)[:, :some]
            s, o = np.take_along_axis(s, near, 1), np.take_along_axis(o, near, 1)
        order = np.lexsort((o, -s), axis=1)[:, :k]
        s, o = np.take_along_axis(s, order, 1), np.take_along_axis(o, order, 1)
    keep = s >= -1.5
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], keep.shape)[keep]), pa.array(o[keep]), pa.array(s[keep])], names=["query_id", "neighbour_id", "sim"])


HIT = "query_id bigint, neighbour_id bigint, sim double"


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _met(rows: DataFrame, queries: DataFrame, sizes: dict[int, int], k: int, width: int) -> DataFrame:
    """Hits of queries (query_id, x, cell, a row for each cell that one meets) among the rows of those cells, k a block and query."""
    asked = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
    parts = lambda n, most: -(-n // most)
    blocks = rows.sparkSession.createDataFrame([(c, parts(sizes[c], ROWS), parts(n, QUERIES)) for c, n in asked.items()], "cell int, r int, q int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = rows.join(F.broadcast(blocks), "cell").select("id", "y", "cell", F.pmod("at", "r").cast("int").alias("rb"), all_of("q").alias("qb"))
    b = queries.join(F.broadcast(blocks), "cell").select("query_id", "x", "cell", all_of("r").alias("rb"), F.pmod(F.xxhash64("query_id"), "q").cast("int").alias("qb"))
    key = ["cell", "rb", "qb"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own = right.column("query_id").to_numpy(), left.column("id").to_numpy()
        if not len(ids) or not len(own):
            return pa.table({"query_id": pa.array([], pa.int64()), "neighbour_id": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        return pa.Table.from_batches([best(ids, _matrix(right.column("x"), width), own, _matrix(left.column("y"), width), k)])

    return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(run, HIT)


def join(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", pivots: int = 0, report: Callable[[int, int], None] | None = None) -> DataFrame:
    """query_id, neighbour_id, sim, rank: the k rows of greatest cosine (six places; ties by id) of each query, itself left out.

    Vectors have the length of the longest query; others, and those with null or infinite components, are left out. Of queries
    with the same id one counts. A zero vector has similarity 0 to all. pivots: 0 for about the root of the number of rows.
    report: gets how many times a query met a cell, and how many times it would have met all.
    """
    spark = vectors.sparkSession
    none = spark.createDataFrame([], HIT + ", rank int")
    width = queries.agg(F.max(F.size(vector))).first()[0]
    if not width or width < 1:
        return none
    count = vectors.count()
    first = vectors.filter((F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull())).orderBy(F.xxhash64(key), key).limit(min(PIVOTS, pivots or max(1, int(count**0.5)))).select(vector).collect()
    made, _ = unit(pa.array([[float(v) for v in r[0]] for r in first], pa.list_(pa.float64())), width)
    made = np.unique(made[np.abs(made).sum(axis=1) > 0], axis=0)
    if not len(made):
        made = np.eye(1, width)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in _sliced(batches):
            x, some = unit(batch.column(1), width)
            angles = _angles(x, made)
            zero = ~x.any(axis=1)
            cell = np.where(zero, ZERO, angles.argmin(axis=1)) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(cell.astype(np.int32)), pa.array(np.where(zero, 0.0, angles.min(axis=1, initial=9.0))), pa.array(np.arange(at, at + len(x))), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "cell", "angle", "at", "y"])
            at += len(x)

    rows = cut(vectors.select(F.col(key).cast("bigint"), vector).mapInArrow(dealt, "id bigint, cell int, angle double, at bigint, y binary"))
    cells = {r["cell"]: (r["n"], r["radius"]) for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()}
    if not cells:
        return none
    held = np.array(sorted(c for c in cells if c != ZERO), np.int64)
    sizes, radius = {c: n for c, (n, _) in cells.items()}, np.array([cells[c][1] for c in held])
    filled = np.array([sizes[c] for c in held])

    def home(x: np.ndarray) -> Iterator[np.ndarray]:
        """The cells nearest to each query that hold k rows besides itself; zero vectors' where no other has any."""
        if not len(held):
            yield from ([ZERO] for _ in x)
            return
        for angles in _angles(x, made[held]):
            order = np.argsort(angles, kind="stable")
            yield held[order[: int(np.searchsorted(np.cumsum(filled[order]), k + 1)) + 1]]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            x, some = unit(batch.column(1), width)
            yield from told(batch.column(0).take(pa.array(some)), x, list(home(x)))

    asked = cut(queries.select(F.col(key).cast("bigint").alias("query_id"), vector).dropDuplicates(["query_id"]))
    near = cut(asked.mapInArrow(start, "query_id bigint, x binary, cell int"))
    hits = cut(_met(rows, near, sizes, k, width))
    order = F.desc("sim"), F.asc("neighbour_id")
    bound = best_rows(hits, ["query_id"], order, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("sim")).alias("least"))

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            x, some = unit(batch.column(1), width)
            ids, least = batch.column(0).take(pa.array(some)), batch.column(2).to_numpy(zero_copy_only=False)[some]
            least = np.where(np.isnan(least), -1.0, least)
            reach = np.where(x.any(axis=1), np.arccos(np.clip(least - SLACK, -1.0, 1.0)), np.inf)  # a zero query is as near to any row
            lower = _angles(x, made[held]) - radius[None, :]
            of = []
            for i, h in enumerate(home(x)):
                more = held[lower[i] <= reach[i] + SLACK]
                zero = [ZERO] if ZERO in sizes and ZERO not in h and (least[i] <= SLACK or not np.isfinite(reach[i])) else []
                of.append(np.array([*np.setdiff1d(more, h), *zero]))
            yield from told(ids, x, of)

    rest = cut(asked.join(bound, "query_id", "left").select("query_id", vector, "least").mapInArrow(further, "query_id bigint, x binary, cell int"))
    if report:
        report(near.count() + rest.count(), asked.count() * len(cells))
    both = hits.unionAll(_met(rows, rest, sizes, k, width))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k)
