"""Operator 9, near-duplicates by SimHash under a Gray-order hierarchical index.

1. A fingerprint for each text: a narrow map.
2. Distinct fingerprints, each with its least doc_id (partial aggregation, so copies never meet in one task).
3. Every fingerprint goes to one place for each choice of two of six blocks of bits: two fingerprints that differ in at most
   four bits agree in two blocks at least, so some place holds both. A place that many fingerprints share is split into
   chunks of Gray order, and each pair of chunks becomes a task of its own: any two still meet.
4. In a place, fingerprints are sorted by the rank of their Gray code. Upper nodes hold the bits that all below them share
   (mask and pattern); two nodes are pruned as soon as their shared bits differ in more than four places. Only what joins two
   classes is returned: at most one link for each fingerprint and place, never all pairs.
5. Links are contracted to components over distinct fingerprints, by rounds of aggregation and joins, each cut by a checkpoint.

That is the operator at a radius of four bits, which is far stricter than a similarity of 0.8 (some 10 bits apart). To
remove near-duplicates at a similarity, ``deduplicate`` uses the same index at a wider radius: ``near_copies`` says how.

Null text and text without a word: fingerprint zero, linked as any other. Null doc_id: it has a fingerprint and a
component but gives no component its name; a component of nothing but null doc_ids has a null component_id. Repeated rows
are linked as copies; deduplicate() keeps one of them. Further columns, clashing names too, stay as they are. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, small, whole_texts

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Six blocks of bits; places are named by two of them.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Fingerprints of a place beyond which it is split into chunks of this size.
CHUNK = 8192
#: Children of a node of the index.
FAN_OUT = 16
#: Pairs of nodes that are opened at once.
PAIRS = 2048


def fingerprints(texts: list[str]) -> np.ndarray:
    """SimHash of the 4-word shingles, repeats included, by XXH64 with seed 42: a bit is 1 if set in over half of them."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        # Only A-Z is lower-cased, which bytes.lower() does; bytes.split() cuts at the six ASCII white-space characters.
        words = text.encode("utf-8").lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        n = len(words) - SHINGLE + 1
        if n <= 1:
            hashes.append(xxh64_intdigest(joined, SEED))
            counts[i] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
        hashes += [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
        counts[i] = n
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    # Eight byte-wide counters in a uint64, for eight bits at a time; runs of at most 255 hashes can't overflow one.
    data = np.array(hashes, np.uint64)
    n = counts[some]
    runs = -(-n // 255)
    nth = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    at = np.repeat(np.cumsum(n) - n, runs) + 255 * nth
    of_text = np.cumsum(runs) - runs
    ones = np.uint64(0x0101010101010101)
    for j in range(8):
        lanes = np.add.reduceat((data >> np.uint64(j)) & ones, at).astype("<u8").view(np.uint8).reshape(-1, 8)
        sums = np.add.reduceat(lanes.astype(np.int64), of_text, axis=0)
        for k in range(8):
            out[some] |= (2 * sums[:, k] > n).astype(np.uint64) << np.uint64(8 * k + j)
    return out


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id and fp (bigint with the fingerprint's bits) of every row."""

    def make():
        def work(part: pa.RecordBatch) -> list:
            return [part.column("doc_id"), pa.array(fingerprints(whole_texts(part.column("text"))).view(np.int64))]

        return work

    return map_texts(docs, "doc_id bigint, fp bigint", make)


# ---- the index -------------------------------------------------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the Gray code's sequence, where neighbours differ in one bit."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class Classes:
    """Union-find over places 0..n-1 for many pairs at a time; label[i] is the least place of i's class."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            low, high = np.minimum(la, lb), np.maximum(la, lb)
            # Every class that is the higher one of some pair hooks onto a lower one: one link each, no cycles.
            pick = np.full(len(self.label), -1)
            pick[high[::-1]] = np.arange(len(high))[::-1]
            first = pick[pick >= 0]  # in order of place
            self.label[high[first]] = low[first]
            self.links += zip(a[first].tolist(), b[first].tolist(), strict=True)
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


class GrayIndex:
    """Distinct fingerprints in Gray order under nodes of FAN_OUT children; a node knows the bits that all below it share."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.radius = radius
        self.order = np.argsort(gray_rank(prints), kind="stable")
        leaf = prints[self.order]
        ones = ~np.uint64(0)
        self.pattern, self.mask = [leaf], [np.full(len(leaf), ones)]
        while len(self.pattern[-1]) > 1:
            p, m = self.pattern[-1], self.mask[-1]
            at = np.arange(0, len(p), FAN_OUT)
            every = np.bitwise_and.reduceat(p, at)
            some = np.bitwise_or.reduceat(p, at)
            shared = np.bitwise_and.reduceat(m, at) & ~(every ^ some)
            self.pattern.append(every & shared)
            self.mask.append(shared)

    def join(self, classes: Classes, apart: np.ndarray | None = None, unite: Callable[[np.ndarray, np.ndarray], None] | None = None) -> None:
        """Unite all that are within the radius. apart: of each fingerprint, a chunk; only pairs of different chunks count.

        unite: gets the pairs within the radius instead, as places, and unites those that it verifies.
        """
        side = None if apart is None else apart[self.order]
        step = np.arange(FAN_OUT)
        left, right = np.repeat(step, FAN_OUT), np.tile(step, FAN_OUT)
        # Pairs of nodes, level by level; a bounded number at a time, the rest waits.
        waiting = [(len(self.pattern) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while waiting:
            level, a, b = waiting.pop()
            if len(a) > PAIRS:
                waiting += [(level, a[PAIRS:], b[PAIRS:]), (level, a[:PAIRS], b[:PAIRS])]
                continue
            if level <= 2:  # what is one class already needs no look
                low, high = self._labels(classes, level)
                open_ = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
                a, b = a[open_], b[open_]
            # Both nodes' children against each other; a node with itself only once.
            n = len(self.pattern[level - 1])
            ca, cb = (a[:, None] * FAN_OUT + left).ravel(), (b[:, None] * FAN_OUT + right).ravel()
            fit = (ca < n) & (cb < n) & ((ca < cb) if level == 1 else (ca <= cb))
            ca, cb = ca[fit], cb[fit]
            p, m = self.pattern[level - 1], self.mask[level - 1]
            near = np.bitwise_count((p[ca] ^ p[cb]) & m[ca] & m[cb]) <= self.radius
            ca, cb = ca[near], cb[near]
            if level > 1:
                if len(ca):
                    waiting.append((level - 1, ca, cb))
                continue
            if side is not None:
                other = side[ca] != side[cb]
                ca, cb = ca[other], cb[other]
            (unite or classes.join)(self.order[ca], self.order[cb])

    def _labels(self, classes: Classes, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest label below each node of a level."""
        own = classes.label[self.order]
        at = np.arange(0, len(own), FAN_OUT**level)
        return np.minimum.reduceat(own, at), np.maximum.reduceat(own, at)


def links_of(prints: np.ndarray, apart: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Places of linked fingerprints that hold the classes of distinct fingerprints together: a forest."""
    classes = Classes(len(prints))
    if len(prints) > 1:
        GrayIndex(prints).join(classes, apart)
    return classes.links


def _place_links(places: DataFrame) -> DataFrame:
    """Links a, b of fingerprints within the radius that share a place. places: place, half, fp, clustered and sorted by place.

    A place's rows come one after another, so memory holds one place (at most two chunks) and one batch at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(place: np.ndarray, half: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1], [True])))
            out: list[np.ndarray] = []
            sizes = np.diff(edge)
            # Places of two are compared all at once.
            two = edge[:-1][sizes == 2]
            near = (np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS) & ((half[two] < 0) | (half[two] != half[two + 1]))
            out.append(np.stack((fp[two[near]], fp[two[near] + 1]), axis=1))
            for k in np.flatnonzero(sizes > 2).tolist():
                own, side = fp[edge[k] : edge[k + 1]], half[edge[k] : edge[k + 1]]
                got = links_of(own, side if side[0] >= 0 else None)
                if got:
                    out.append(own[np.array(got, np.int64)])
            pairs = np.concatenate(out).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            place, half, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(place):
                continue
            fp = fp.view(np.uint64)
            last = np.searchsorted(place, place[-1]) if place[0] <= place[-1] else int(np.flatnonzero(place != place[-1])[-1]) + 1
            if last:
                held.append((place[:last], half[:last], fp[:last]))
                yield linked(*map(np.concatenate, zip(*held, strict=True)))
                held = []
            held.append((place[last:], half[last:], fp[last:]))
        if held:
            yield linked(*map(np.concatenate, zip(*held, strict=True)))

    return places.mapInArrow(run, "a bigint, b bigint")


def links(prints: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links between distinct fingerprints (column fp) that differ in at most RADIUS bits, enough to hold every class together."""
    routed = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), _block_value(pair).alias("v")) for k, pair in enumerate(combinations(range(6), 2))))).alias("p")).select(
        "fp", F.shiftleft(F.col("p.v"), 4).bitwiseOR(F.col("p.k")).alias("place")
    )
    crowded = cut(routed.groupBy("place").count().filter(F.col("count") > chunk).select("place", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")))
    plain = routed.join(small(crowded.select("place")), "place", "left_anti").select("place", F.lit(-1).cast("int").alias("half"), "fp")
    # A crowded place: chunk c of its fingerprints goes to each task (c, d) of a pair of chunks. Chunks are dealt by hash
    # of the fingerprint, so each has about the same share; within a task the index restores Gray order.
    split = routed.join(small(crowded), "place").select("place", "fp", "chunks", F.pmod(F.xxhash64("fp"), F.col("chunks").cast("bigint")).cast("int").alias("c"))
    pairs = split.select(
        "place", "fp", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("d")
    ).select(F.xxhash64("place", F.least("c", "d"), F.greatest("c", "d")).alias("place"), F.when(F.col("c") == F.col("d"), F.lit(-1)).otherwise(F.col("c")).cast("int").alias("half"), "fp")
    # A task of two different chunks compares across them only; each chunk's inner pairs are its task (c, c).
    both = plain.unionByName(pairs)
    return _place_links(both.repartition("place").sortWithinPartitions("place", "half", "fp"))


def _block_value(pair: tuple[int, int]):
    a, b = (F.shiftrightunsigned("fp", BLOCKS[i][0]).bitwiseAND(F.lit((1 << BLOCKS[i][1]) - 1)) for i in pair)
    return F.shiftleft(a, 11).bitwiseOR(b)


# ---- components ------------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b): root is the same for all nodes of a component.

    Each round every node takes the least of its neighbours and itself as parent, parents are followed to their ends (the
    depth doubles with each join), and edges are redrawn between the ends: only nodes less than all their neighbours remain.
    """
    live = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    known: DataFrame | None = None
    while not live.isEmpty():
        both = live.unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")))
        moved = True
        while moved:
            jumped = cut(parent.join(parent.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            moved, parent = not jumped.filter("moved").isEmpty(), jumped.select("node", "up")
        if known is None:
            known = parent.withColumnRenamed("up", "root")
        else:  # roots so far move up
            known = cut(known.join(parent.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        to = lambda c, parent=parent: parent.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))
        live = cut(live.join(to("a"), "a").join(to("b"), "b").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).filter("a <> b").distinct())
    return known if known is not None else live.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp of every row; fp, component_id of every distinct fingerprint that has company or not)."""
    rows = cut(fingerprint_table(docs))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(prints.select("fp")))
    named = prints.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, cut(named.select("fp", "root").join(least, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id of every row."""
    rows, named = classified(docs)
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _marks(docs: DataFrame, names: tuple[str, str]) -> DataFrame:
    """docs with two independent 64-bit hashes of the whole row; rows with both alike are taken as repeated."""
    whole = [x for c, t in docs.dtypes for x in (F.to_json(F.col(f"`{c}`")) if "map<" in t or t == "variant" else F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return docs.withColumns({n: F.xxhash64(F.lit(i), *whole) for i, n in enumerate(names)})


def unrepeated(marked: DataFrame, rows: DataFrame, names: tuple[str, str], ways: int = 64) -> DataFrame:
    """marked with one row for each pair of marks. rows: the marks of all its rows, cut.

    Only rows that repeat are brought together, and first in many parts: however often one repeats, every task keeps one
    of it, ``ways`` parts gather from some tasks each, and the last step gathers from the parts.
    """
    again = cut(rows.groupBy(*names).count().filter("count > 1").select(*names))
    if again.isEmpty():
        return marked
    again, whole = small(again), F.struct(*(F.col(f"`{c}`") for c in marked.columns))
    met = marked.join(again, list(names), "left_semi").select(*names, F.pmod(F.spark_partition_id(), F.lit(ways)).alias("__way"), whole.alias("__row"))
    one = met.groupBy(*names, "__way").agg(F.first("__row").alias("__row")).groupBy(*names).agg(F.first("__row").alias("__row"))
    return marked.join(again, list(names), "left_anti").select(*(F.col(f"`{c}`") for c in marked.columns)).unionByName(cut(one.select("__row.*")))


def deduplicate(docs: DataFrame, **more) -> DataFrame:
    """One row, all columns, of each group of near-duplicates at a Jaccard similarity of 0.8: see ``near_copies``."""
    from . import near_copies

    return near_copies.deduplicate(docs, **more)
