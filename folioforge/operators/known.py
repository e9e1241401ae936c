"""Exclusion of known ids at any size of either side.

Few candidates: the known ids that they hit are found by a semi join that broadcasts the candidates. Few known ids: those are
broadcast. Otherwise a Bloom filter of the known ids goes to the tasks; candidates that it rules out are new for sure and stay
where they are, and only the others are shuffled to the anti join that decides.
"""

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import BROADCAST_ROWS, cut

#: Bytes of a filter at most, and of the pieces in which tasks hand theirs on.
MOST_BYTES, PIECE = 1 << 26, 1 << 16
#: A filter that passes more than this share of unknown ids isn't worth its making.
WORST = 0.5


def _spread(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of a 64-bit hash; the second is odd."""
    h = h.astype(np.uint64)
    a = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    b = (a ^ (a >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return a ^ (a >> np.uint64(32)), (b ^ (b >> np.uint64(32))) | np.uint64(1)


@dataclass(frozen=True)
class Shape:
    """bits is a power of two; rate is the share of unknown ids that pass."""

    bits: int
    hashes: int
    rate: float

    @classmethod
    def of(cls, n: int, rate: float, most_bytes: int = MOST_BYTES) -> "Shape":
        wanted = max(1.0, -n * math.log(rate) / math.log(2) ** 2)
        bits = min(1 << max(PIECE * 8 - 1, math.ceil(wanted) - 1).bit_length(), 1 << (most_bytes * 8).bit_length() - 1)
        hashes = max(1, round(bits / max(n, 1) * math.log(2)))
        hashes = min(hashes, 8)
        return cls(bits, hashes, (1 - math.exp(-hashes * n / bits)) ** hashes)

    def places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        a, b = _spread(h)
        for i in range(self.hashes):
            yield ((a + np.uint64(i) * b) & np.uint64(self.bits - 1)).astype(np.int64)


def build(ids: DataFrame, shape: Shape) -> np.ndarray:
    """The filter's bytes: each task sets bits of its own, pieces that are not blank are joined by their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(shape.bits // 8, np.uint8)
        for batch in batches:
            for at in shape.places(batch.column(0).to_numpy(zero_copy_only=False)):
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        held = [(i, bits[lo : lo + PIECE]) for i, lo in enumerate(range(0, len(bits), PIECE))]
        held = [(i, x.tobytes()) for i, x in held if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int32()), pa.array([x for _, x in held], pa.binary())], names=["piece", "bits"])

    def joined(piece: pa.Table) -> pa.Table:
        out = np.zeros(PIECE, np.uint8)
        for x in piece.column("bits").to_pylist():
            out |= np.frombuffer(x, np.uint8)
        return pa.table({"piece": piece.column("piece")[:1], "bits": pa.array([out.tobytes()], pa.binary())})

    pieces = ids.select(F.xxhash64(ids.columns[0]).alias("h")).mapInArrow(run, "piece int, bits binary").groupBy("piece").applyInArrow(joined, "piece int, bits binary")
    out = np.zeros(shape.bits // 8, np.uint8)
    for r in pieces.toLocalIterator():
        out[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["bits"], np.uint8)
    return out


def flagged(rows: DataFrame, key: str, bits: np.ndarray, shape: Shape, name: str = "__maybe") -> DataFrame:
    """rows with a column that is false where the key is unknown for sure."""
    sent = rows.sparkSession.sparkContext.broadcast(bits.tobytes())

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        held, out = np.frombuffer(sent.value, np.uint8), np.ones(len(h), np.bool_)
        for at in shape.places(h.to_numpy()):
            out &= (held[at >> 3] >> (at & 7)) & 1 == 1
        return pd.Series(out)

    return rows.withColumn(name, maybe(F.xxhash64(key)))


def exclude(candidates: DataFrame, known: DataFrame, key: str = "arxiv_id", rate: float = 0.01, few: int = BROADCAST_ROWS, most_bytes: int = MOST_BYTES, report: Callable[[str, int, int, float], None] | None = None) -> DataFrame:
    """Candidates (all columns) whose key isn't among the known. A null key is known by nothing.

    report: gets the way taken (candidates, known, filter, join), rows of candidates that are shuffled, all of them, and the rate
    at which a filter passes unknown ones.
    """
    ids = known.select(key).filter(F.col(key).isNotNull())
    tell = report or (lambda *a: None)
    n = candidates.count()
    if n <= few:
        hit = cut(ids.join(F.broadcast(candidates.select(key).distinct()), key, "left_semi").distinct())  # no more than candidates
        tell("candidates", 0, n, 0.0)
        return candidates.join(F.broadcast(hit), key, "left_anti")
    m = ids.count()
    if m <= few:
        tell("known", 0, n, 0.0)
        return candidates.join(F.broadcast(ids), key, "left_anti")
    shape = Shape.of(m, rate, most_bytes)
    if shape.rate > WORST:
        tell("join", n, n, shape.rate)
        return candidates.join(ids, key, "left_anti")
    rows = cut(flagged(candidates, key, build(ids, shape), shape))
    maybe = rows.filter("__maybe")
    tell("filter", maybe.count(), n, shape.rate)
    return rows.filter("not __maybe").unionByName(maybe.join(ids, key, "left_anti")).drop("__maybe")
