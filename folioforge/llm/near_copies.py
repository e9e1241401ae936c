"""Operator 9 at a similarity: near-duplicates by five-word shingles and a Jaccard similarity of 0.8 or more.

1. A text's key is the hash of its words; equal keys are copies. Only distinct keys go on.
2. At 0.8, SimHash fingerprints of 64 bits differ in some 10 bits, in 22 at the tail: no choice of bits that must agree would
   send two such texts to one place and keep others apart. So places are MinHash bands over the shingles, BANDS
   bands of ROWS values: a pair of similarity s shares one with probability 1 - (1 - s**ROWS)**BANDS, 0.9998 at 0.8.
3. In a place, the SimHash fingerprints of the texts' shingle sets lie in the Gray-order index, which prunes whole groups
   and gives the pairs within ``RADIUS`` differing bits. Their Jaccard similarity is then computed exactly, and it decides.
   A pair at 0.8 lies further apart with a probability of some 1 in 50,000 if the texts are long; ``tests/llm`` measures it.
   Bands with the same members are one. A crowded band, of more than CHUNK members or BYTES of text, is dealt into chunks. What its
   largest class then leaves over, if that is a chunk or less, meets all members in further tasks: so a large group of near
   copies costs no square of its size. If more is left over, its members have much in common without being copies, as forms and
   pages with the same furniture do. They are dealt anew, to FINE_BANDS bands of FINE_ROWS further values: a pair at 0.8
   shares one with probability 0.9999, one at 0.6 in 0.38, and of a whole group with a common part of 0.6 only 0.006 have a band's
   value in common. Only fine bands that are crowded still, and leave more than a chunk over, cost a square of that rest.
4. Verified links are contracted to components.

Words are cut at ASCII white space and only A-Z is lower-cased, as in operator 9. A text of fewer than five words is one
shingle; texts without a word, null too, are copies of each other. Keys and shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, map_texts, mixed, shingles, slices, small, whole_texts
from .simhash_dedup import Classes, GrayIndex, _marks, components, unrepeated

SHINGLE = 5
ROWS, BANDS = 4, 16
#: Differing bits up to which the index proposes a pair.
RADIUS = 22
#: Members of a band, and bytes of their texts, beyond which it is dealt into chunks of about this size. One text may be larger.
CHUNK, BYTES = 512, 1 << 27
FINE_ROWS, FINE_BANDS = 10, 80
_SALT = mixed(np.arange(1, ROWS * BANDS + FINE_ROWS * FINE_BANDS + 1, dtype=np.uint64))
_FACTOR = mixed(_SALT) | np.uint64(1)


def _lowered(texts: list[str]) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass").lower() for x in texts]


def text_shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all texts, repeats included, and the text of each, in order of the texts."""
    words = Words(texts)
    hashes, counts = words.hashes(), np.diff(words.first)
    of = words.text_of()
    h = shingles(hashes, SHINGLE)
    inside = np.arange(len(h)) + SHINGLE <= words.first[of[: len(h)] + 1]
    h, t = h[inside], of[: len(h)][inside]
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(few):
        whole = []
        for i in few.tolist():
            x = np.full(1, counts[i], np.uint64)
            for w in hashes[words.first[i] : words.first[i + 1]]:
                x = mixed(x ^ w)
            whole.append(x)
        h, t = np.concatenate((h, *whole)), np.concatenate((t, few))
        order = np.argsort(t, kind="stable")
        h, t = h[order], t[order]
    return h, t


def _bands(texts: list[bytes], rows: int = ROWS, bands: int = BANDS, at: int = 0) -> list[np.ndarray]:
    """The hashes of each text's bands, of the values from one on: none without a word."""
    out = [np.zeros(0, np.int64) for _ in texts]
    h, t = text_shingles(texts)
    if not len(h):
        return out
    first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
    made = np.zeros((len(first), bands), np.uint64)
    for i in range(rows * bands):
        least = np.minimum.reduceat((h ^ _SALT[at + i]) * _FACTOR[at + i], first)
        made[:, i // rows] = mixed(made[:, i // rows] ^ least) + _SALT[at + i]
    for i, row in zip(t[first].tolist(), made.view(np.int64), strict=True):
        out[i] = row
    return out


def keys_and_bands(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The key of each text, and the hashes of its bands."""
    from xxhash import xxh64_intdigest

    low = _lowered(texts)
    return np.array([xxh64_intdigest(b" ".join(x.split())) for x in low], np.uint64), _bands(low)


def sets_of(texts: list[str]) -> list[np.ndarray]:
    """The sorted set of shingles of each text."""
    h, t = text_shingles(_lowered(texts))
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.ones(len(h), np.bool_)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    h, t = h[new], t[new]
    return np.split(h, np.searchsorted(t, np.arange(1, len(texts))))


def set_prints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of each set of shingles: a bit is 1 if set in over half of them."""
    out = np.zeros(len(sets), np.uint64)
    for i, s in enumerate(sets):
        n = np.zeros(64, np.int64)
        for lo in range(0, len(s), 1 << 16):
            n += np.unpackbits(s[lo : lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * n > len(s), bitorder="little").view("<u8")[0]
    return out


def links_among(sets: list[np.ndarray], side: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Places of verified pairs that hold all classes together. Where side isn't negative, only pairs of 0 and 1 count.

    The index proposes pairs. As long as some that aren't one class are left, the member of most of them is compared with all
    others at once, over the postings of its shingles.
    """
    n, sizes = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    classes, across = Classes(n), bool(side[0] >= 0)
    ends = np.cumsum(sizes)
    ids = posting = to = None
    compared = np.zeros(n, np.bool_)

    def compare(i: int) -> None:
        nonlocal ids, posting, to
        if ids is None:
            _, ids = np.unique(np.concatenate(sets), return_inverse=True)
            posting = np.repeat(np.arange(n), sizes)[np.argsort(ids, kind="stable")]
            to = np.cumsum(np.bincount(ids))
        compared[i] = True
        own = ids[ends[i] - sizes[i] : ends[i]]
        stop, count = to[own], to[own] - np.where(own > 0, to[own - 1], 0)
        at = np.repeat(stop - np.cumsum(count), count) + np.arange(count.sum())
        both = np.bincount(posting[at], minlength=n)
        near = 5 * both >= 4 * (sizes[i] + sizes - both)  # a Jaccard similarity of 0.8, in whole numbers
        near[i] = False
        if across:
            near &= side != side[i]
        b = np.flatnonzero(near)
        classes.join(np.full(len(b), i), b)

    def unite(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            left = (classes.label[a] != classes.label[b]) & ~compared[a] & ~compared[b]
            a, b = a[left], b[left]
            if len(a):
                compare(int(np.bincount(np.concatenate((a, b)), minlength=n).argmax()))

    if n > 1:
        GrayIndex(set_prints(sets), radius).join(classes, side if across else None, unite)
    return classes.links


def _verified(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links a, b. members: place, side, key; texts: key, text. A place is held as sets of shingles, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        place = None

        def linked() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                got = links_among([s for _, _, s in held], np.array([s for s, _, _ in held]))
                if got:
                    a, b = (pa.array([held[p[k]][1] for p in got], pa.int64()) for k in (0, 1))
                    yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

        for batch in batches:
            for part in slices(batch):
                places, side, key = (part.column(i).to_pylist() for i in range(3))
                for p, s, k, shingled in zip(places, side, key, sets_of(whole_texts(part.column("text"))), strict=True):
                    if p != place:
                        yield from linked()
                        held.clear()
                        place = p
                    held.append((s, k, shingled.copy()))
        yield from linked()

    met = members.join(texts, "key").select("place", "side", "key", "text")
    return met.repartition("place").sortWithinPartitions("place").mapInArrow(run, "a bigint, b bigint")


def _members(pairs: DataFrame) -> DataFrame:
    """band, n, bytes, key of bands with company. pairs: key, size, band. Bands with the same members are one."""
    bands = pairs.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sum(F.shiftright(F.xxhash64("key"), 24)).alias("who"), F.min("key").alias("least"), F.max("key").alias("most")).filter("n > 1")
    bands = cut(bands.groupBy("n", "who", "least", "most").agg(F.min("band").alias("band"), F.max("bytes").alias("bytes")).select("band", "n", "bytes"))
    return cut(pairs.join(small(bands), "band").select("band", "n", "bytes", "key"))


def _parts(n: str, size: str, chunk: int) -> Column:
    return F.greatest(F.ceil(F.col(n) / chunk), F.ceil(F.col(size) / BYTES), F.lit(1))


def _dealt(parts: Column) -> Column:
    return F.pmod(F.xxhash64("key", "band"), parts)


def _within(members: DataFrame, texts: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame | None]:
    """Links within bands, or within the chunks of crowded ones; and the crowded bands of more than one class: band, n, bytes, key,
    root, main (the largest class), rest (how many members are in others)."""
    parts = _parts("n", "bytes", chunk)
    place = F.when(parts > 1, F.xxhash64("band", _dealt(parts))).otherwise(F.col("band"))
    first = cut(_verified(members.select(place.alias("place"), F.lit(-1).alias("side"), "key"), texts))
    crowded = members.filter(parts > 1)
    if crowded.isEmpty():
        return first, None
    roots = components(first).withColumnRenamed("node", "key")
    crowded = cut(crowded.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))
    sizes = crowded.groupBy("band", "root").count()
    largest = sizes.groupBy("band").agg(F.max_by("root", F.struct("count", "root")).alias("main"), (F.sum("count") - F.max("count")).alias("rest")).filter("rest > 0")
    return first, crowded.join(small(cut(largest)), "band")


def _across(crowded: DataFrame, texts: DataFrame, chunk: int) -> DataFrame:
    """Links between what the largest class of a crowded band leaves over and all its members."""
    many = lambda parts: F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))
    whole, rest = _parts("n", "bytes", chunk), F.greatest(F.ceil(F.col("rest") / chunk), F.ceil(F.col("bytes") * F.col("rest") / F.col("n") / BYTES), F.lit(1))
    over = crowded.filter("root <> main").select("band", "key", F.lit(0).alias("side"), _dealt(rest).alias("r"), many(whole).alias("c"))
    every = crowded.select("band", "key", F.lit(1).alias("side"), _dealt(whole).alias("c"), many(rest).alias("r"))
    return _verified(over.unionByName(every).select(F.xxhash64("band", "r", "c", F.lit(1)).alias("place"), "side", "key"), texts)


def links(rows: DataFrame, marked: DataFrame, names: tuple[str, str], chunk: int = CHUNK) -> DataFrame:
    """Verified links between keys. rows: key, size, bands and the marks of each row of marked, which has the texts."""
    pairs = cut(rows.select("key", "size", F.explode("bands").alias("band")).groupBy("key", "band").agg(F.max("size").alias("size")))
    members = _members(pairs)
    one = rows.join(members.select("key").distinct(), "key").groupBy("key").agg(F.min(F.struct(*names)).alias("m")).select("key", *(F.col(f"m.{x}").alias(x) for x in names))
    texts = cut(marked.select(*names, "text").join(small(cut(one)), list(names)).groupBy("key").agg(F.max("text").alias("text")))
    first, crowded = _within(members, texts, chunk)
    if crowded is None:
        return first
    crowded = cut(crowded)
    found = first.unionAll(_across(crowded.filter(F.col("rest") <= chunk), texts, chunk))
    alike = cut(crowded.filter(F.col("rest") > chunk).select("key").distinct())
    if alike.isEmpty():
        return found

    def make():
        return lambda part: [part.column("key"), pa.compute.binary_length(part.column("text")), pa.array(_bands(_lowered(whole_texts(part.column("text"))), FINE_ROWS, FINE_BANDS, ROWS * BANDS), pa.list_(pa.int64()))]

    fine = map_texts(texts.join(small(alike), "key"), "key bigint, size bigint, bands array<bigint>", make, ("key", "text"))
    second, left = _within(_members(cut(fine.select("key", "size", F.explode("bands").alias("band")))), texts, chunk)
    found = found.unionAll(second)
    return found if left is None else found.unionAll(_across(left, texts, chunk))


def deduplicate(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row, all columns, of each component: the least doc_id (null last); of equal doc_ids the least hash of the row."""
    names = ("__copies_mark0", "__copies_mark1")

    def make():
        def work(part: pa.RecordBatch) -> list:
            keys, bands = keys_and_bands(whole_texts(part.column("text")))
            size = pa.compute.fill_null(pa.compute.binary_length(part.column("text")), 0)
            return [*(part.column(c) for c in ("doc_id", *names)), pa.array(keys.view(np.int64)), size, pa.array(bands, pa.list_(pa.int64()))]

        return work

    marked = _marks(docs, names)
    rows = cut(map_texts(marked, f"doc_id bigint, {names[0]} bigint, {names[1]} bigint, key bigint, size bigint, bands array<bigint>", make, ("doc_id", *names, "text")))
    marked = unrepeated(marked, rows, names)
    roots = components(links(rows, marked, names, chunk))
    named = rows.select("key").distinct().join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("root"))
    # Partial minima, so a component of any size is no one task's burden.
    first = rows.drop("bands", "size").join(cut(named), "key").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *names)).alias("m"))
    keep = cut(first.select(*(F.col(f"m.{n}").alias(n) for n in names)))
    return marked.join(keep, list(names), "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
