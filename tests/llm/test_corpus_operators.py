"""Operators 3, 5 and 9 and the pipeline."""

import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioforge.llm import quality_model, queries, simhash_dedup, surrogates
from test_near_copies import brute_kept
from test_text_operators import ODD, table

# ---- 3 ---------------------------------------------------------------------------------------------------------------


def replaced(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in surrogates.find_and_replace(df, key).orderBy("doc_id").collect()]


def test_surrogates_keep_form(spark):
    texts = [
        "Mail Jo.Doe42@mail3.example.com or CALL +1 (469) 555-3334, from 152.143.123.13. End",
        "card 4111111111111111$$$ and 4111 1111 1111 1111, ssn 123-45-6789.",
        "Mr. John Smith met Frau Anna Becker; later Mr. Smith left. г-жа Анна Петрова.",
        "JO.DOE42@MAIL3.EXAMPLE.COM; jo.doe42@mail3.example.com; other@mail3.example.com",
        "DE89 3704 0044 0532 0130 00 and (469) 555-3334 and 14695553334",
        "Plain text, version 1.2.3 of 2024-01-02, 12345 items; nothing here.", None, "",
    ]
    out = replaced(spark, texts)
    assert out[5:] == texts[5:]
    for secret in ("Doe42", "555-3334", "152.143", "4111", "123-45-6789", "Smith", "Becker", "Петрова", "DOE42", "3704"):
        assert not any(secret in (x or "") for x in out)
    m = re.fullmatch(r"Mail ([A-Za-z]+\.[A-Za-z]+\d\d)@([a-z]+\d)\.([a-z]+)\.com or CALL (\+1 \(\d{3}\) \d{3}-\d{4}), from (\d{3}\.\d{3}\.\d{3}\.\d\d)\. End", out[0])
    assert m
    cards = re.fullmatch(r"card (\d{16})\$\$\$ and (\d{4} \d{4} \d{4} \d{4}), ssn (\d{3}-\d\d-\d{4})\.", out[1])
    assert cards and cards[1] == cards[2].replace(" ", "") and cards[1][0] == "4"
    luhn = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(cards[1]))
    assert luhn % 10 == 0
    p = re.fullmatch(r"Mr\. (\w+) (\w+) met Frau (\w+) (\w+); later Mr\. (\w+) left\. г-жа (\w+) (\w+)\.", out[2])
    assert p and p[2] == p[5] and p[3].endswith("a") and not p[1].endswith("a") and re.fullmatch("[а-яА-Я]+", p[6] + p[7])
    a, b, c = out[3].split("; ")
    assert a == b.upper() and b.split("@")[1] == c.split("@")[1] and b.split("@")[0] != c.split("@")[0]
    assert b.lower() == out[0].split()[1].lower()
    assert re.match(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d and \(\d{3}\) \d{3}-\d{4}", out[4])
    assert replaced(spark, texts) == out and replaced(spark, texts, "other key") != out


def test_surrogates_stay_distinct(spark):
    """A form with few values: more clashes than there is room for at first, none at the end."""
    texts = [f"write {a}{b}@x.org now" for a in "abcdefghijklmnopqrst" for b in "0123456789"] * 2
    out = replaced(spark, texts)
    new = [x.split()[1] for x in out]
    assert new[:200] == new[200:] and len(set(new[:200])) == 200
    assert not set(new) & {x.split()[1] for x in texts}


def test_surrogates_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in queries.op3_pii_surrogates(spark, sf_dir).collect()}
    pattern = re.compile(r"[^\W_]+\.\d\d@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<!\w)\d{16}(?!\w)|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w])")
    for r in docs.collect():
        found = pattern.findall(r.text)
        assert not any(x in got[r.doc_id].text for x in found)
        if not re.search(r"\d", r.text):
            assert got[r.doc_id].text == r.text


def test_surrogate_edges(spark):
    df = table(spark, [*ODD, "a@b.co " * 2000])
    out = surrogates.pseudonymised(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert {r.doc_id: r.text for r in out.collect()}[0] is None and surrogates.pseudonymised(df.limit(0)).count() == 0
    plan = surrogates.pseudonymised(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- 5 ---------------------------------------------------------------------------------------------------------------


def test_classifier_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op5_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.97
    p = np.clip([r.score for r in held], 1e-9, 1 - 1e-9)
    y = np.array([r.quality for r in held])
    assert -np.log(np.where(y == 1, p, 1 - p)).mean() < 0.1


def test_classifier_edges(spark):
    df = table(spark, [*ODD, *(f"good words {i} in a row." for i in range(40)), *("BAD!! " * 9 for _ in range(40))])
    labels = spark.createDataFrame([(i, 1 if i < len(ODD) + 40 else 0, 0) for i in range(3, len(ODD) + 80)] + [(5, 0, 0), (5, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_model.classify_quality(df, labels).collect()
    assert len(out) == df.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality_model.classify_quality(df, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality_model.classify_quality(df, labels.filter("quality = 1 and doc_id <> 5")).collect()} == {1.0}
    assert quality_model.keep_good(df, labels).columns == df.columns and quality_model.classify_quality(df.limit(0), labels).count() == 0


# ---- 9 ---------------------------------------------------------------------------------------------------------------


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(v >> b & 1 for v in h) > len(h)) << b for b in range(64))


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    p = np.array(prints, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(p[i] ^ p[i + 1 :]) <= 4) + i + 1:
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    members = {}
    for i, (d, _) in enumerate(rows):
        members.setdefault(root(i), []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return sorted(((d, f"{prints[i]:016x}", least[root(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def test_components_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted(map(tuple, queries.op9_simhash_dedup(spark, "/root/testdata/sf0.01").collect()), key=repr)
    assert got == brute_components(rows)


def test_simhash_edges_and_dedup(spark):
    df = table(spark, [*ODD, "A b  c", "a B\tc", "a b c d e", "a b c d e"])
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute_components(rows)
    assert sorted(map(tuple, simhash_dedup.near_duplicates(df).collect()), key=repr) == want
    kept = simhash_dedup.deduplicate(df)
    got = kept.collect()
    assert kept.columns == df.columns and sorted(r.doc_id for r in got if r.doc_id is not None) == sorted({c for _, _, c in want if c is not None})
    assert simhash_dedup.near_duplicates(df.limit(0)).count() == 0 and simhash_dedup.deduplicate(df.limit(0)).count() == 0
    lone = spark.createDataFrame([(None, "x y z"), (None, "x y z")], "doc_id long, text string")
    assert simhash_dedup.deduplicate(lone).count() == 1 and simhash_dedup.near_duplicates(lone).first().component_id is None


@pytest.mark.parametrize("flips,apart", [(0, False), (3, False), (6, True), (40, True)])
def test_gray_index_against_all_pairs(flips, apart):
    rng = np.random.default_rng(flips)
    p = rng.integers(0, 1 << 63, 12, dtype=np.uint64)[rng.integers(0, 12, 500)]
    for _ in range(flips):
        p = p ^ (np.uint64(1) << rng.integers(0, 64, len(p)).astype(np.uint64))
    p = np.unique(p)
    side = rng.integers(0, 2, len(p)) if apart else None
    up = list(range(len(p)))

    def root(u, i):
        while u[i] != i:
            i = u[i]
        return i

    for i in range(len(p)):
        for j in np.flatnonzero(np.bitwise_count(p[i] ^ p[i + 1 :]) <= 4) + i + 1:
            if side is None or side[i] != side[j]:
                a, b = root(up, i), root(up, int(j))
                up[max(a, b)] = min(a, b)
    own = list(range(len(p)))
    for i, j in simhash_dedup.links_of(p, side):
        assert np.bitwise_count(p[i] ^ p[j]) <= 4
        a, b = root(own, i), root(own, j)
        assert a != b
        own[max(a, b)] = min(a, b)
    assert [root(own, i) for i in range(len(p))] == [root(up, i) for i in range(len(p))]


def test_crowded_places_split(spark):
    """Chunks far smaller than the places: the pairs of chunks must find the same classes."""
    rng = np.random.default_rng(3)
    p = np.full(400, 0x0123456789ABCDEF, np.uint64)
    for _ in range(7):
        p = p ^ (np.uint64(1) << rng.integers(0, 64, len(p)).astype(np.uint64))
    prints = spark.createDataFrame([(int(x),) for x in np.unique(p).view(np.int64)], "fp long")

    def classes(chunk):
        roots = {r.node: r.root for r in simhash_dedup.components(simhash_dedup.links(prints, chunk)).collect()}
        groups = {}
        for x in np.unique(p).view(np.int64).tolist():
            groups.setdefault(roots.get(x, x), set()).add(x)
        return sorted(map(sorted, groups.values()))

    assert classes(16) == classes(100_000)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 140)] + [(200, 201), (200, 200)]
    got = {r.node: r.root for r in simhash_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[201] == 200


# ---- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    quality = {r.doc_id: r.predicted for r in queries.op5_quality_classifier(spark, sf_dir).collect()}
    at, kept = docs, {r.doc_id: r.text for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        at = stage(spark, at, sf_dir)
        assert at.columns == docs.columns
        now = {r.doc_id: r.text for r in at.collect()}
        if k == 0:
            assert now.keys() == {i for i in kept if quality[i]}
        if k == 1:
            assert sorted(now, key=repr) == brute_kept(list(kept.items()))  # five words, 0.8: the stage's contract, not operator 9's digest
        if k == 2:
            leaks = {r.doc_id for r in queries.op10_decontamination(spark, sf_dir).collect()}
            assert now.keys() == kept.keys() - leaks
        if k == 3:
            assert now.keys() == kept.keys()
        kept = now
        at = spark.createDataFrame(at.collect(), docs.schema)
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(kept) and all(len(r.ids) == r.length for r in rows)


def test_extra_columns_pass_the_stages(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"fp": F.lit("x"), "m": F.lit(1), "score": F.array(F.lit(0))})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), sf_dir).count() == 0


def test_cut_tables_are_swept(spark, tmp_path):
    from pathlib import Path

    from folioforge.llm import common

    t = common.cut(spark.range(5))
    folder = Path(t.inputFiles()[0].removeprefix("file://")).parent
    assert t.count() == 5 and folder.exists()
    common.sweep(spark)
    assert not folder.exists()
