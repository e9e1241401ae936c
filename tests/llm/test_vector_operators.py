"""Operators 11 and 13 against plain Python, and their edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import centroids, vector_codes, vectors


def usable(v, dims=None):
    return v is not None and len(v) > 0 and (dims is None or len(v) == dims) and all(x is not None and math.isfinite(x) for x in v)


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def brute_clusters(rows, k, rounds, scale, dims):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if usable(v, dims)]
    h = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    c = [q for _, q in sorted(kept, key=lambda r: (h(r[0]), r[1]))[:k]]
    at = lambda q: min(range(len(c)), key=lambda j: (apart(q, c[j]), j))
    for _ in range(rounds):
        got = [(at(q), q) for _, q in kept]
        own = {j: [q for a, q in got if a == j] for j in range(len(c))}
        c = [tuple(sum(x) // len(own[j]) for x in zip(*own[j], strict=True)) if own[j] else c[j] for j in range(len(c))]
    last = [(i, at(q), apart(q, c[at(q)])) for i, q in kept]
    total = {j: sum(d for _, a, d in last if a == j) for j in range(len(c))}
    return sorted(((i, a, d, total[a], sum(total.values()), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for i, a, d in last), key=repr)


def brute_codes(rows, entries, rounds, parts, scale, width):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows if usable(v, width)]
    size = width // parts
    cut = lambda q: [tuple(q[p * size : (p + 1) * size]) for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(q)[p] for _, _, q in first] for p in range(parts)]
    near = lambda p, x: min(range(len(books[p])), key=lambda j: (apart(x, books[p][j]), j))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, _, q in kept:
                own.setdefault(near(p, cut(q)[p]), []).append(cut(q)[p])
            books[p] = [tuple(sum(x) // len(own[j]) for x in zip(*own[j], strict=True)) if j in own else e for j, e in enumerate(books[p])]
    out, of = [], {}
    for i, label, q in kept:
        codes = [near(p, x) for p, x in enumerate(cut(q))]
        e = sum(apart(x, books[p][codes[p]]) for p, x in enumerate(cut(q)))
        out.append((i, "".join(f"{c:02x}" for c in codes), e, label))
        of[label] = of.get(label, 0) + e
    said = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, of[label], said) for i, c, e, label in out), key=repr)


def told(df):
    return sorted(map(tuple, df.collect()), key=repr)


def odd_rows(dims, n=60, spread=3.0, seed=1):
    """Vectors with many ties, a third of all the same, repeated rows and ids, null ids and labels, and those to be left out."""
    rnd = random.Random(seed)
    some = [(i, i % 3 or None, [rnd.choice([-1.0, 0.0, 0.25, 1.0]) * spread for _ in range(dims)]) for i in range(n)]
    same = [(1000 + i, 7, [0.5] * dims) for i in range(n // 2)]
    left_out = [(1, 1, None), (2, 1, []), (3, None, [math.nan] + [0.0] * (dims - 1)), (4, 2, [None] * dims), (5, 2, [math.inf] * dims), (6, 2, [1.0] * (dims - 1)), (None, None, None)]
    return some + same + [some[0], some[0], (some[1][0], 2, some[2][2]), (None, None, some[3][2]), (None, 5, some[4][2])] + left_out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    return df.withColumns({"whole": F.lit("x"), "n": F.lit(1), "cluster": F.lit("c"), "code": F.lit(2), "error": F.lit("e"), "label_error": F.lit(0), "__on": F.lit(1)})


@pytest.mark.parametrize("k", [1, 5, 500])
def test_clusters_are_those_of_plain_python(spark, k):
    rows = odd_rows(8)
    got, held = centroids.cluster(frame(spark, rows), k=k, dims=8)
    assert told(got) == brute_clusters([(i, v) for i, _, v in rows], k, 3, 64, 8)
    assert len(held) == min(k, sum(usable(v, 8) for _, _, v in rows))


@pytest.mark.parametrize("spread", [3.0, 9e4])
def test_large_components_are_exact_too(spark, spread):
    rows = odd_rows(8, spread=spread, seed=2)
    assert told(centroids.cluster(frame(spark, rows), k=6, dims=8)[0]) == brute_clusters([(i, v) for i, _, v in rows], 6, 3, 64, 8)
    assert told(vector_codes.compress(frame(spark, rows), entries=9, scale=1024)[0]) == brute_codes(rows, 9, 4, 4, 1024, 8)


def test_components_beyond_64_bits_are_an_error(spark):
    with pytest.raises(Exception, match="beyond 64 bits"):
        centroids.cluster(frame(spark, [(1, 1, [1e30] * 4), (2, 1, [-1e30] * 4)]), dims=4)


@pytest.mark.parametrize("entries", [3, 40, 256])
def test_codes_are_those_of_plain_python(spark, entries):
    rows = odd_rows(8, seed=3)
    got, books = vector_codes.compress(frame(spark, rows), entries=entries)
    assert told(got) == brute_codes(rows, entries, 4, 4, 1024, 8)
    first = vector_codes.decoded(got, books).filter("vec_id = 1000").first()
    p = [books[i][int(first["code"][2 * i : 2 * i + 2], 16)] for i in range(4)]
    assert first["vector"] == [x / 1024 for e in p for x in e]


def test_empty_tables_give_no_rows(spark):
    for rows in ([], [(1, 1, None), (2, None, [math.nan])]):
        for out, held in (centroids.cluster(frame(spark, rows)), vector_codes.compress(frame(spark, rows))):
            assert out.collect() == [] and held == [] and out.columns[0] == "vec_id"
    assert vector_codes.compress(frame(spark, []))[0].columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_lengths_that_cannot_be_cut_are_an_error(spark):
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(frame(spark, [(1, 1, [1.0] * 6)]))


@pytest.mark.parametrize("alphabet", [3, 2000])
def test_tree_finds_the_lowest_of_the_nearest(alphabet):
    rnd = np.random.default_rng(alphabet)
    book, parts = rnd.integers(-alphabet, alphabet, (256, 4)), rnd.integers(-alphabet, alphabet, (9000, 4))
    book[100:120] = book[7]
    tree = vector_codes.Tree(book)
    code, best = tree.search(parts)
    d = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (code == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert tree.visited < 0.6 * tree.most  # bounds keep most parts out of most leaves


def test_heavy_groups_meet_their_rows_by_broadcast(spark):
    """Rows of a third of all, rows of null, and rows of a value of their own."""
    rows = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 7 when id % 3 = 1 then null else id end as g")
    groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    out = vectors.rejoined(rows, groups, "g", "n", 3000)
    top = {r["g"]: r["top"] for r in groups.collect()}
    assert out.columns == ["id", "g", "top"] and out.count() == 3000 and all(r["top"] == top[r["g"]] for r in out.collect())


def test_sums_beyond_64_bits_are_an_error():
    s = vectors.Sums(2, 1)
    s.add(np.array([0, 0, 1]), np.array([[3], [-5], [1 << 40]]), np.array([2, 1, 4]))
    assert s.counts.tolist() == [3, 4] and s.sums.tolist() == [[1], [1 << 42]]
    with pytest.raises(OverflowError):
        s.add(np.array([0]), np.array([[1 << 61]]), np.array([9]))
