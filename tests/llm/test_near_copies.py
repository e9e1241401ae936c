"""The pipeline's near-dedup against all pairs of five-word shingle sets."""

import numpy as np
import pytest

from folioforge.llm import near_copies
from test_text_operators import ODD, table


def brute_kept(rows):
    """The least doc_id (null last) of each component of similarity 0.8 or more."""

    def shingled(text):
        words = (text or "").encode().lower().split()
        return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets, up = [shingled(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for j in range(len(rows)):
        for i in range(j):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return sorted((min((x for x in v if x is not None), default=None) for v in groups.values()), key=repr)


def kept(df, **more):
    return sorted((r.doc_id for r in near_copies.deduplicate(df, **more).collect()), key=repr)


def test_pipeline_takes_edited_copies_and_nothing_less(spark):
    """0/7818 (0.888, five bits) and 1/2926 (0.83, eight bits) are copies; 7818/9506 (0.618, within four bits) are none."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    left = lambda *ids: {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, docs.filter(docs.doc_id.isin(*ids)), "").collect()}
    assert left(0, 1, 2926, 7818) == {0, 1} and left(7818, 9506) == {7818, 9506}


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert kept(docs) == brute_kept([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("chunk", [8, 512])
def test_crowded_bands(spark, chunk):
    """A band far larger than a chunk, with some members that are near to few or none."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(150):
        words = list(base)
        for i in rng.integers(0, 60, rng.integers(0, 4)).tolist() if k % 5 else rng.integers(0, 12, 3).tolist():
            words[i] = f"x{rng.integers(0, 30)}"
        texts.append(" ".join(words))
    df = table(spark, [*ODD, *texts, "A b  c", "a B\tc", "a b c d", "a b c d e"])
    assert kept(df, chunk=chunk) == brute_kept([(r.doc_id, r.text) for r in df.collect()])


def test_edges(spark):
    df = table(spark, ODD)
    assert near_copies.deduplicate(df).columns == df.columns and near_copies.deduplicate(df.limit(0)).count() == 0
    lone = spark.createDataFrame([(None, "x y z"), (None, "x y z")], "doc_id long, text string")
    assert near_copies.deduplicate(lone).count() == 1


def test_recall_of_the_index():
    """Pairs of sets at a similarity of just 0.8, from five shingles on: how many lie within the radius."""
    rng = np.random.default_rng(6)
    near = total = 0
    for n in (9, 18, 45, 90, 450, 1800):
        for _ in range(300):
            apart = max(1, n // 9)  # of n shingles each, all but so many are in both
            own = rng.integers(0, 1 << 63, n + apart, dtype=np.uint64)
            both = near_copies.set_prints([own[:n], own[apart:]])
            assert 5 * (n - apart) >= 4 * (n + apart)
            near += int(np.bitwise_count(both[0] ^ both[1])) <= near_copies.RADIUS
            total += 1
    assert near >= 0.995 * total


def test_rows_that_repeat(spark):
    """A row that makes up most of the table, in many partitions, and repeated rows with null ids."""
    rows = [(7, "one and the same text of some words here", 1)] * 4000 + [(i, f"another text number {i} of its own kind w{i} x{i}", 2) for i in range(20, 40)] + [(None, "a row without an id that is here twice", 3)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, __row long").repartition(9)
    out = near_copies.deduplicate(df).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in out) == sorted({(r[0] is None, r[0], r[1]) for r in rows}) and out[0].asDict().keys() == set(df.columns)


def test_index_against_all_pairs():
    """Classes of sets within a place, in one side and across two, against exact similarities of all pairs."""
    rng = np.random.default_rng(8)
    for across in (False, True):
        pool = rng.integers(0, 1 << 63, (6, 60), dtype=np.uint64)
        sets = []
        for k in range(200):
            s = pool[k % 6].copy()
            s[rng.integers(0, 60, rng.integers(0, 9))] = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
            sets.append(np.unique(s))
        side = rng.integers(0, 2, 200) if across else np.full(200, -1)
        side[0] = 0 if across else -1
        label, own = list(range(200)), list(range(200))

        def root(up, i):
            while up[i] != i:
                i = up[i]
            return i

        for i in range(200):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and (not across or side[i] != side[j]):
                    a, b = root(label, i), root(label, j)
                    label[max(a, b)] = min(a, b)
        for i, j in near_copies.links_among(sets, side):
            a, b = root(own, i), root(own, j)
            own[max(a, b)] = min(a, b)
        assert [root(own, i) for i in range(200)] == [root(label, i) for i in range(200)]


def test_texts_with_a_common_part(spark, monkeypatch):
    """Forms: two thirds of every text are the same, so all meet in bands, but few are copies. What is sent grows with their number."""
    rng = np.random.default_rng(8)
    form = [f"form{i}" for i in range(200)]
    own = lambda: [f"own{x}" for x in rng.integers(0, 10**6, 100)]
    sent = []
    verified = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda members, texts: (sent.append(members.count()), verified(members, texts))[1])
    counts = {}
    for n in (400, 800):
        texts = [" ".join(form + own()) for _ in range(n)]
        texts += [t.replace("form7 ", "changed ") for t in texts[:: n // 20]]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        sent.clear()
        assert kept(df, chunk=64) == sorted(range(n), key=repr)
        counts[n] = sum(sent) / len(texts)
    assert max(counts.values()) < 6  # rows a text; all against all in chunks would be 13 a band


def test_places_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BYTES", 3000)
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(w if rng.random() > 0.004 else "x" for w in base) for _ in range(60)] + ["long " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert kept(df) == brute_kept([(r.doc_id, r.text) for r in df.collect()])
