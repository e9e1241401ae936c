"""Operator 10, benchmark decontamination.

Windows of a text that are as long as an item (and, since a passage may be cut short, of nine and eight tenths of it) get a
256-bit SimHash of their five-word shingles, each weighed by how rare it is among all items. A multi-index over
blocks of the fingerprints gives every item of that length within ``RADIUS`` differing bits: of 16 blocks, some block of
two such fingerprints differs in at most 63 // 16 = 3 of its 16 bits. Items come from this index and from nowhere else; each is
then verified by the exact weighted Jaccard similarity of its shingles (repeats count) and the window's, trimmed to the
first and last shingle that both have.

A window is fingerprinted only if the benchmark's vocabulary of shingles, whichever items they are of, makes up as much of its weight
as the lightest item of its length needs for a match. That is a bound on what can match, so it skips no match; it
tells nothing about which item it is.

What the index misses: at similarity 0.8 fingerprints of long items differ in 39 bits on average with a deviation of 5.7, so 63
are 4 deviations off; of five shingles they differ in 48 with 6.2. ``tests/llm`` measures recall by item length: 0.99 or more.

Weights are counted over the whole benchmark, by an aggregation. Items are then taken in blocks of at most ``ITEMS`` items and
``BLOCK_SHINGLES`` shingles; each block is a narrow map over all documents, and rows don't depend on how items fall into blocks.

Null or empty text, document or item: matches nothing. An item under five words has no shingle and matches nothing. A text
shorter than an item is one window. Of windows of equal similarity the first, then the shorter one is told. Repeated
documents or items match each on their own. Null ids are carried as they are. Further columns don't matter. Without documents there are
no rows, without items no matches.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shingled, cut, filter_texts, map_texts, member, mixed, small, whole_texts

SHINGLE = 5
SIMILARITY = 0.8
#: Windows for an item of n shingles have these tenths of n.
TENTHS = (10, 9, 8)
BITS = 256
RADIUS = 63
BLOCK_BITS = 16
BLOCKS = BITS // BLOCK_BITS
ITEMS = 20_000
BLOCK_SHINGLES = 2_000_000
#: Windows (and places of a text) that are worked on at once.
AT_ONCE = 4096
_SEEDS = mixed(np.arange(1, BITS // 64 + 1, dtype=np.uint64))
#: All differences of a block that the radius allows, as masks.
_MASKS = np.array([sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(BLOCK_BITS), k)], np.uint16)


def weight(items: int, holding: np.ndarray) -> np.ndarray:
    """Whole numbers, so that sums don't depend on their order: the rarer among all items, the heavier."""
    return np.maximum(1, np.rint(1000 * np.log1p(items / np.maximum(holding, 1)))).astype(np.int64)


def signs(hashes: np.ndarray) -> np.ndarray:
    """A row of BITS ones and minus ones for each shingle."""
    wide = mixed(hashes[:, None] ^ _SEEDS[None, :])
    return 2 * np.unpackbits(wide.astype("<u8").view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little").astype(np.int8) - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, four words each, of rows of weighted sums of signs."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1)


class HammingBlocks:
    """Fingerprints by the values of their blocks; find() gives all pairs within the radius, and no others.

    Where there are fewer fingerprints than values within reach of a block's value, the fingerprints' blocks are looked
    through; else the values within reach are looked up in the sorted blocks. Either way the same candidates come out.
    """

    def __init__(self, prints: np.ndarray):
        self.prints = np.ascontiguousarray(prints, "<u8").reshape(len(prints), BITS // 64)
        self.blocks = self.prints.view("<u2")
        self.few = len(prints) <= len(_MASKS)
        if self.few:
            return
        self.order = np.argsort(self.blocks, axis=0, kind="stable")
        self.values = np.take_along_axis(self.blocks, self.order, axis=0)
        # For each block, which values have a fingerprint within reach: a bit each.
        self.reach = np.zeros((BLOCKS, 1 << BLOCK_BITS >> 3), np.uint8)
        for b in range(BLOCKS):
            for own in np.array_split(np.unique(self.values[:, b]), len(prints) // AT_ONCE + 1):
                near = np.unique(own[:, None] ^ _MASKS[None, :])
                np.bitwise_or.at(self.reach[b], near >> 3, (1 << (near & 7)).astype(np.uint8))

    def _candidates(self, asked: np.ndarray) -> np.ndarray:
        """Pairs (as one number) some block of which is within reach."""
        n = len(self.prints)
        if self.few:
            got = np.zeros((len(asked), n), np.bool_)
            for b in range(BLOCKS):
                got |= np.bitwise_count(asked[:, b, None] ^ self.blocks[None, :, b]) <= RADIUS // BLOCKS
            return np.flatnonzero(got)
        out = [np.zeros(0, np.int64)]
        for b in range(BLOCKS):
            v = asked[:, b]
            hit = np.flatnonzero(self.reach[b][v >> 3] >> (v & 7).astype(np.uint8) & 1)
            near = (v[hit][:, None] ^ _MASKS[None, :]).ravel()
            low, high = (np.searchsorted(self.values[:, b], near, side=s) for s in ("left", "right"))
            w = np.repeat(np.repeat(hit, len(_MASKS)), high - low)
            at = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange(len(w))
            out.append(w * n + self.order[at, b])
        return np.unique(np.concatenate(out))

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the given fingerprints, which of the index)."""
        asked = np.ascontiguousarray(prints, "<u8").view("<u2")
        n, step, which, own = len(self.prints), max(1, (1 << 20) // len(_MASKS)), [], []
        for low in range(0, len(asked), step):
            pairs = self._candidates(asked[low : low + step])
            w, i = low + pairs // n, pairs % n
            near = distance(prints[w], self.prints[i]) <= RADIUS
            which.append(w[near])
            own.append(i[near])
        none = [np.zeros(0, np.int64)]
        return np.concatenate(which or none), np.concatenate(own or none)


Item = tuple[object, np.ndarray, np.ndarray]


class Benchmark:
    """Items (id, shingles, how many items hold each), ready to be looked for in texts. total: of the whole benchmark."""

    def __init__(self, items: list[Item], total: int, similarity: float = SIMILARITY):
        self.similarity = similarity
        self.ids = [x for x, _, _ in items]
        self.rarest = int(weight(total, np.ones(1))[0])
        self.vocabulary, first = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, h, _ in items)]), return_index=True)
        self.weights = weight(total, np.concatenate([np.zeros(0, np.int64), *(n for _, _, n in items)])[first])
        # Of each item: its distinct shingles, how often it has each, their weights, and the sum.
        self.own: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        prints = np.zeros((len(items), BITS // 64), "<u8")
        for i, (_, h, _) in enumerate(items):
            distinct, times = np.unique(h, return_counts=True)
            w = self.weigh(distinct)
            self.own.append((distinct, times, w, int((times * w).sum())))
            prints[i] = packed(((times * w) @ signs(distinct).astype(np.int64))[None, :])[0]
        lengths = np.array([len(h) for _, h, _ in items], np.int64)
        sums = np.array([x[3] for x in self.own], np.int64)
        # For each length: its items, their index, and the least weight that a match needs.
        self.classes = []
        for n in np.unique(lengths).tolist():
            which = np.flatnonzero(lengths == n)
            self.classes.append((n, which, HammingBlocks(prints[which]), math.ceil(similarity * int(sums[which].min()) - 1e-6)))
        self.least = min((x[3] for x in self.classes), default=0)

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.rarest, np.int64)
        known = member(hashes, self.vocabulary)
        out[known] = self.weights[np.searchsorted(self.vocabulary, hashes[known])]
        return out

    def _windows(self, known: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        """(class, first places, size) of the windows that hold enough known weight. known: its running sum, from 0."""
        n = len(known) - 1
        for c, (length, _, _, need) in enumerate(self.classes):
            if known[-1] >= need:
                for size in {min(n, -(-length * t // 10)) for t in TENTHS}:
                    start = np.flatnonzero(known[size:] - known[: n + 1 - size] >= need)
                    if len(start):
                        yield c, start, size

    def similar(self, window: np.ndarray, weights: np.ndarray, i: int) -> tuple[float, int, int]:
        """Similarity of item i and the window, trimmed to the first and last shingle of the item, and those two places."""
        distinct, times, w, total = self.own[i]
        place = np.minimum(np.searchsorted(distinct, window), len(distinct) - 1)
        shared = np.flatnonzero(distinct[place] == window)
        if not len(shared):
            return 0.0, 0, 0
        a, b = int(shared[0]), int(shared[-1]) + 1
        both = int((np.minimum(np.bincount(place[shared], minlength=len(distinct)), times) * w).sum())
        return both / (int(weights[a:b].sum()) + total - both), a, b

    def _prints(self, hashes: np.ndarray, weights: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Fingerprints of windows of a text; those whose first places lie near each other share one running sum of signs."""
        out = np.zeros((len(start), BITS // 64), "<u8")
        order = np.argsort(start, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(start[order] // AT_ONCE)) + 1):
            low, high = int(start[part[0]]), int((start[part] + size[part]).max())
            w = weights[low:high]
            sums = np.zeros((high - low + 1, BITS), np.int32 if int(w.sum()) < 1 << 31 else np.int64)
            np.cumsum(signs(hashes[low:high]) * w[:, None].astype(sums.dtype), axis=0, dtype=sums.dtype, out=sums[1:])
            for some in np.split(part, range(AT_ONCE, len(part), AT_ONCE)):
                at = start[some] - low
                out[some] = packed(sums[at + size[some]] - sums[at])
        return out

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int, float]]:
        """(text, item, first word, words, differing bits, similarity): the best window of each text and item."""
        if not self.ids:
            return
        got = Shingled(texts, SHINGLE)
        _, text = got.hits(self.vocabulary)
        # Of each class of items: text, first place, size and fingerprint of the windows to look up.
        asked: dict[int, list[tuple]] = {}
        weighed: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for t in np.unique(text).tolist():
            hashes = got.of_text(t)
            weights, known = self.weigh(hashes), np.zeros(len(hashes) + 1, np.int64)
            np.cumsum(np.where(member(hashes, self.vocabulary), weights, 0), out=known[1:])
            found = list(self._windows(known)) if known[-1] >= self.least else []
            if not found:
                continue
            weighed[t] = hashes, weights
            n = [len(start) for _, start, _ in found]
            start, size = np.concatenate([x[1] for x in found]), np.repeat([x[2] for x in found], n)
            prints = self._prints(hashes, weights, start, size)
            for (c, _, _), to, k in zip(found, np.cumsum(n).tolist(), n, strict=True):
                own = slice(to - k, to)
                asked.setdefault(c, []).append((np.full(k, t), start[own], size[own], prints[own]))
        best: dict[tuple[int, int], tuple] = {}
        for c, windows in asked.items():
            _, which, index, _ = self.classes[c]
            text, start, size, prints = (np.concatenate(x) for x in zip(*windows, strict=True))
            for k, i in zip(*index.find(prints), strict=True):
                t, s, item = int(text[k]), int(start[k]), int(which[i])
                hashes, weights = weighed[t]
                similarity, a, b = self.similar(hashes[s : s + size[k]], weights[s : s + size[k]], item)
                if similarity >= self.similarity - 1e-12:
                    one = (-similarity, s + a, b - a + SHINGLE - 1, int(distance(prints[k], index.prints[i])))
                    if (t, item) not in best or one < best[t, item]:
                        best[t, item] = one
        for t, i in sorted(best):
            similarity, first, words, bits = best[t, i]
            yield t, i, first, words, bits, -similarity


_BUILT: dict[str, Benchmark] = {}


def _ready(key: str, items: list[Item], total: int, similarity: float) -> Benchmark:
    """Built once in each Python worker."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Benchmark(items, total, similarity)
    return _BUILT[key]


def weighed_items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, shingles, shared: the shingles that other items have too and in how many; the number of items with shingles)."""

    def make():
        def work(part: pa.RecordBatch) -> list:
            got = Shingled(whole_texts(part.column("text")), SHINGLE)
            return [part.column("item_id"), pa.array([got.of_text(i).view(np.int64) for i in range(part.num_rows)], pa.list_(pa.int64()))]

        return work

    items = map_texts(benchmark, "item_id bigint, shingles array<bigint>", make, ("item_id", "text")).filter("size(shingles) > 0")
    items = cut(items.withColumn("row", F.monotonically_increasing_id()))
    each = items.select("row", F.explode(F.array_distinct("shingles")).alias("shingle"))
    often = small(cut(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")))
    shared = each.join(often, "shingle").groupBy("row").agg(F.collect_list(F.struct("shingle", "n")).alias("shared"))
    return cut(items.join(shared, "row", "left").drop("row")), items.count()


def item_blocks(benchmark: DataFrame, size: int = ITEMS, most: int = BLOCK_SHINGLES) -> Iterator[Callable[[float], Callable[[], Benchmark]]]:
    """All items in blocks of bounded size, one at a time on the driver; each a recipe that workers follow."""
    items, total = weighed_items(benchmark)
    block: list[Item] = []
    held = 0

    def recipe() -> Callable[[float], Callable[[], Benchmark]]:
        key, own = uuid.uuid4().hex, list(block)
        return lambda similarity: lambda: _ready(f"{key}-{similarity}", own, total, similarity)

    for r in items.toLocalIterator():
        h = np.array(r["shingles"], np.int64).view(np.uint64)
        n = np.ones(len(h), np.int64)
        if r["shared"]:
            often = {x["shingle"]: x["n"] for x in r["shared"]}
            n = np.array([often.get(x, 1) for x in r["shingles"]], np.int64)
        if block and (len(block) == size or held + len(h) > most):
            yield recipe()
            block, held = [], 0
        block.append((r["item_id"], h, n))
        held += len(h)
    if block:
        yield recipe()


SCHEMA = "doc_id bigint, item_id bigint, first_word bigint, n_words bigint, n_bits bigint, similarity double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, size: int = ITEMS) -> DataFrame:
    """A row for each document and benchmark item that it holds, with the best window."""

    def found(ready: Callable[[], Benchmark]) -> DataFrame:
        def make():
            bench = ready()

            def work(part: pa.RecordBatch) -> list:
                rows = list(bench.matches(whole_texts(part.column("text"))))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                t = pa.array(columns[0], pa.int64())
                return [part.column("doc_id").take(t), pa.array([bench.ids[i] for i in columns[1]], pa.int64()), *(pa.array(c, pa.int64()) for c in columns[2:5]), pa.array(columns[5], pa.float64())]

            return work

        return map_texts(docs, SCHEMA, make)

    out = None
    for recipe in item_blocks(benchmark, size):
        # Of several blocks, each one's result is written before the next one is read.
        out = found(recipe(similarity)) if out is None else cut(out).unionAll(cut(found(recipe(similarity))))
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, size: int = ITEMS) -> DataFrame:
    """The documents, all columns, that hold no benchmark item."""

    def kept(docs: DataFrame, ready: Callable[[], Benchmark]) -> DataFrame:
        def make():
            bench = ready()

            def work(part: pa.RecordBatch) -> np.ndarray:
                keep = np.ones(part.num_rows, np.bool_)
                keep[[m[0] for m in bench.matches(whole_texts(part.column("text")))]] = False
                return keep

            return work

        return filter_texts(docs, make)

    for k, recipe in enumerate(item_blocks(benchmark, size)):
        docs = kept(cut(docs) if k else docs, recipe(similarity))
    return docs
