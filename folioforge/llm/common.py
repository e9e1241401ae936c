"""What the operators of this subpackage share: batches of texts, lineage cuts, word hashes.

A text operator is a narrow map over Arrow batches: no shuffle, memory bounded by one slice of
``SLICE_BYTES`` (or one document, if that is larger), and any lost task is simply run again.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are worked on at once.
SLICE_BYTES = 1 << 20
#: Rows up to which a table of a few bytes a row may be broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}
_CUTS: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, which all executors and the driver see; one of our own only where that is unset."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "folder" not in _OWN:
        _OWN["folder"] = tempfile.mkdtemp(prefix="folioforge-")
        atexit.register(shutil.rmtree, _OWN["folder"], ignore_errors=True)
    return _OWN["folder"]


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, so that lost executors cost no recomputation.

    A table that is read again also brings a fresh plan with true sizes; a checkpoint would carry all constraints of the
    plan before it along, which grow beyond bounds in a loop.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/folioforge-{uuid.uuid4().hex}"
    _CUTS.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Deletes the tables that this process has cut. Results that still read them must have been written before."""
    while _CUTS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (cut, narrow rows) with a broadcast hint if it has at most that many rows; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def whole_texts(column: pa.Array) -> list[str]:
    """The texts, null as empty."""
    return [x or "" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``most`` bytes together (one row at least)."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def map_texts(
    docs: DataFrame,
    schema: str | T.StructType,
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    columns: tuple[str, ...] = ("doc_id", "text"),
    text: str = "text",
    most: int = SLICE_BYTES,
) -> DataFrame:
    """A narrow map: ``make()`` runs once a task and gives a function from a slice of the columns to result arrays."""
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, work = to_arrow_schema(out), make()
        for batch in batches:
            for part in slices(batch, text, most):
                arrays = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in work(part)]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, arrow, strict=True)], schema=arrow)

    return docs.select(*columns).mapInArrow(run, out)


def filter_texts(docs: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], np.ndarray]], text: str = "text") -> DataFrame:
    """The rows of docs, all columns, for which the function of a slice gives True. A narrow map; no join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(work(part), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


# ---- words and their hashes, for a whole slice at a time -------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, np.bool_)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", int(_ODD)), ("down", pow(int(_ODD), -1, 1 << 64))):
            out = np.empty(size, np.uint64)
            out[0], have, step = 1, 1, base
            while have < size:
                np.multiply(out[:have], np.uint64(step), out=out[have : 2 * have])
                have, step = 2 * have, step * step % (1 << 64)
            _POWERS[name] = out
    return _POWERS["up"], _POWERS["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words (runs of bytes that are no ASCII white space) of many texts.

    data: all bytes; start, end: of each word; first: index of each text's first word, with the end at last.
    """

    def __init__(self, texts: list[bytes], separators: np.ndarray = _SPACE):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = separators[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(self.data) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_at = np.concatenate(([0], np.cumsum(lengths + 1)))
        self.first = np.searchsorted(self.start, self.text_at)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        up, down = _powers(len(self.data))
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=total[1:])
        return mixed((total[self.end] - total[self.start]) * down[self.start])

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * _ODD + h[i : i + n]
    return mixed(out)


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which uint64 values are in the sorted array: a small table of their low bits rules out almost all others."""
    if not len(among) or not len(values):
        return np.zeros(len(values), np.bool_)
    bits = max(16, min(24, int(len(among) * 32).bit_length()))
    mask = np.uint64((1 << bits) - 1)
    seen = np.zeros(1 << bits, np.bool_)
    seen[among & mask] = True
    out = seen[values & mask]
    at = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(among, values[at]), len(among) - 1)
    out[at] = among[place] == values[at]
    return out


#: Bytes that end a word where case and punctuation shall not matter: all ASCII but letters and digits.
PUNCTUATION = np.ones(256, np.bool_)
PUNCTUATION[128:] = False
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


class Shingled:
    """The k-word shingles of many texts, regardless of case and ASCII punctuation."""

    def __init__(self, texts: list[str], k: int):
        self.k = k
        self.words = Words([x.lower().encode("utf-8", "surrogatepass") for x in texts], PUNCTUATION)
        self.word_hashes = self.words.hashes()
        self.hashes = shingles(self.word_hashes, k)

    def hits(self, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (and their texts) of the shingles that the sorted array has, none of them across two texts."""
        at = np.flatnonzero(member(self.hashes, among))
        text = np.searchsorted(self.words.first, at, side="right") - 1
        inside = at + self.k <= self.words.first[text + 1]
        return at[inside], text[inside]

    def of_text(self, i: int) -> np.ndarray:
        """The shingles of text i."""
        a, b = self.words.first[i], self.words.first[i + 1]
        return self.hashes[a : max(a, b - self.k + 1)]
