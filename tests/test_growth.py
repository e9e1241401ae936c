"""What grows: citations with many matches."""

from pyspark.sql import functions as F

from folioforge.functions.similarity import citation_score
from folioforge.operators import audit, known, matching, neighbours


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_rows_pass_on_a_few_of_a_heavy_key(spark):
    rows = spark.range(20_000).selectExpr("case when id % 3 = 0 then 0 else id % 50 end as k", "id", "id * 7919 % 1000 as score")
    best = audit.best_rows(rows, ["k"], [F.desc("score"), F.asc("id")], 3)
    said = plan(best)
    assert said.count("WindowGroupLimit") == 2 and said.index("Final") < said.index("hashpartitioning") < said.index("Partial")
    want = {}
    for r in rows.collect():
        want.setdefault(r.k, []).append((-r.score, r.id))
    got = {}
    for r in best.collect():
        got.setdefault(r.k, []).append((-r.score, r.id))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:3] for k, v in want.items()}


def test_citations_of_a_title_that_many_rows_carry(spark):
    index = spark.range(500).selectExpr(
        "id as doc_id", "case when id % 3 = 0 then 'A common title' when id % 3 = 1 then concat('A common title, part ', id) else concat('Other words ', id) end as title",
        "case when id % 7 = 0 then 'it cites A Common Title here' else '' end as abstract", "concat('Author', id % 5) as authors", "concat(2000 + id % 20, '-01-01') as update_date",
    )
    asked = [(1, "A common title", "author1", 2003), (2, "a COMMON title!", "", 0), (3, "a common title", None, None), (4, "never written", "x", 2000), (5, "", "", 0), (6, None, None, None), (7, "A common title", "author1", 2003), (8, "words 5", "", 2005)]
    got = {}
    for r in audit.check_citations(spark.createDataFrame(asked, "cite_id long, title string, authors_hint string, year_hint int"), index).collect():
        got.setdefault(r.cite_id, []).append((r.doc_id, r.score, r.status))
    rows = index.collect()
    for i, title, who, year in asked:
        t = " ".join("".join(c for c in (title or "").lower() if c.isalnum() or c == " ").split())
        held = [r for r in rows if t and any(f" {t} " in " " + x.lower().replace(",", "") + " " for x in (r.title, r.abstract))]
        best = sorted((-citation_score(title, r.title, year or 0, int(r.update_date[:4]), who or "", r.authors), r.doc_id) for r in held)[:3]
        assert sorted(got[i], key=lambda x: (-x[1], x[0] or 0)) == ([(d, -s, "VERIFIED" if -s >= 0.7 else "SUSPECTED" if -s >= 0.4 else "NOT_FOUND") for s, d in best] or [(None, 0.0, "NOT_FOUND")])
    assert got[1] == got[7]


def brute_nearest(rows, queries, k):
    import numpy as np

    width = max((len(v) for _, v in queries if v), default=0)
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    fit = lambda v: v is not None and len(v) == width and None not in v and np.isfinite(v).all()
    out = []
    for q, x in {i: v for i, v in queries if fit(v)}.items():
        sims = sorted((-round(float(unit(x) @ unit(y)), 6) + 0.0, i) for i, y in rows if fit(y) and i != q)
        out += [(q, i, -s + 0.0, n + 1) for n, (s, i) in enumerate(sims[:k])]
    return sorted(out)


def test_nearest_by_pivots(spark, monkeypatch):
    """A third of the rows the same, clusters, ties, zero vectors, rows to be left out, queries that aren't rows; small blocks."""
    import random

    monkeypatch.setattr(neighbours, "ROWS", 50)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    rnd = random.Random(5)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(i, [c + rnd.gauss(0, 0.02) for c in centres[i % 12]]) for i in range(400)] + [(1000 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(200)]
    rows += [(2000, [0.0] * 6), (2001, [0.0] * 6), (2002, None), (2003, []), (2004, [1.0] * 5), (2005, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2006, [float("nan")] * 6)]
    queries = [r for r in rows if r[0] % 10 == 0] + [(9000, [0.0] * 6), (9001, [-1.0, -2.0, 0.0, 0.0, 0.0, -1.0]), (9002, None)]
    frame = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>").withColumn("sim", F.lit(1))
    seen = []
    for k, pivots in ((5, 0), (5, 12), (250, 3), (5, 1)):
        got = neighbours.join(frame(rows), frame(queries), k, pivots=pivots, report=lambda met, of: seen.append((met, of)))
        assert sorted(map(tuple, got.collect())) == brute_nearest(rows, queries, k)
    assert seen[1][0] < 0.6 * seen[1][1]  # most cells are skipped where vectors form clusters
    assert sorted(map(tuple, matching.nearest(frame(rows), frame(queries), 5).collect())) == brute_nearest(rows, queries, 5)
    monkeypatch.setattr(matching, "BLOCK", 5)
    assert sorted(map(tuple, matching.nearest(frame(rows), frame(queries), 5).collect())) == brute_nearest(rows, queries, 5)
    for a, q in (([], queries), (rows, []), (rows, [(1, None)]), ([(1, [0.0] * 6)], [(1, [0.0] * 6), (2, [0.0] * 6)])):
        assert sorted(map(tuple, neighbours.join(frame(a), frame(q), 3).collect())) == brute_nearest(a, q, 3)


def test_known_ids_are_excluded_whatever_is_large(spark):
    candidates = spark.range(30_000).selectExpr("case when id % 100 = 0 then null when id % 3 = 0 then 'a7' else concat('a', id) end as arxiv_id", "id as v", "true as maybe")
    ids = spark.range(20_000).selectExpr("case when id % 50 = 0 then null else concat('a', id * 3 % 20011) end as arxiv_id")
    have = {r[0] for r in ids.collect()} - {None}
    want = sorted((r.v, r.arxiv_id) for r in candidates.collect() if r.arxiv_id not in have)
    told = {}
    for few, most in ((0, 1 << 26), (25_000, 1 << 26), (40_000, 1 << 26), (0, 1 << 10)):
        got = known.exclude(candidates, ids, few=few, most_bytes=most, report=lambda *a: told.setdefault(a[0], a[1:]))
        assert got.columns == candidates.columns and sorted((r.v, r.arxiv_id) for r in got.collect()) == want
    assert set(told) == {"filter", "known", "candidates", "join"}
    shuffled, of, rate = told["filter"]
    hits = sum(r.arxiv_id in have for r in candidates.collect())
    assert of == 30_000 and rate <= 0.01 and hits <= shuffled <= hits + 0.03 * of
    for a, b in ((candidates.limit(0), ids), (candidates, ids.limit(0))):
        for few in (0, 10**6):
            assert known.exclude(a, b, few=few).count() == a.count()
    assert known.Shape.of(10**9, 0.01).rate > known.Shape.of(10**6, 0.01).rate


def test_cut_tables_are_swept(spark):
    from folioforge import shared

    shared.sweep(spark)
    table = shared.cut(spark.range(10))
    path = table.inputFiles()[0]
    assert table.count() == 10 and shared.sweep(spark) == 1 and shared.sweep(spark) == 0
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def test_forms_of_stems(spark, sf_dir):
    import re

    from folioforge.functions.stem import stem
    from folioforge.plans.growth import STEM_FORMS

    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    words = {w for x in texts for w in re.findall(r"[^\W_]+", x.lower())} | {f"{s}{e}" for s in STEM_FORMS for e in ("", "e", "s", "es", "ed", "eds", "ing", "ings", "ly", "ness", "er", "ion")}
    for s, form in STEM_FORMS.items():
        assert {w for w in words if stem(w) == s} == {w for w in words if re.match(form, w)}


def test_queries_that_meet_all_cells_are_told_in_small_batches(monkeypatch):
    """Before, a batch of queries and all cells, each with the query's vector, was one table in memory."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(neighbours, "TOLD", 100)
    ids, x = pa.array(range(40)), np.arange(80.0).reshape(40, 2)
    of = [np.arange(i) if i != 7 else np.arange(300) for i in range(40)]
    made = list(neighbours.told(ids, x, of))
    assert sorted(b.num_rows for b in made)[-2] <= 100 and max(b.num_rows for b in made) == 300
    rows = [(q, tuple(np.frombuffer(v)), c) for b in made for q, v, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
    assert rows == [(i, tuple(x[i]), c) for i in range(40) for c in of[i].tolist()]
    assert [b.num_rows for b in neighbours._sliced([pa.record_batch({"a": range(1100)})])] == [512, 512, 76]


def test_stemmed_matches_are_those_of_plain_python(spark, sf_dir):
    import re

    from folioforge.functions.stem import stem
    from folioforge.plans import bindings, catalogue

    said = {r.sf_id: {stem(w) for w in re.findall(r"[^\W_]+", f"{r.title} {r.authors} {r.abstract}".lower())} for r in bindings.papers(spark, sf_dir).select("sf_id", "title", "authors", "abstract").collect()}
    want = {i for i, w in said.items() if stem("thing") in w or {stem("attion"), stem("the")} <= w}
    assert {r.sf_id for r in catalogue.fts_stemmed(spark, sf_dir).collect()} == want and want
