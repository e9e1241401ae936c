"""The store's invariants, deduplication, queues and audits on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from folioforge.operators import audit, dedup, keyed, matching, queueing, store
from folioforge.schemas import blank_missing, conform


def papers(spark, rows):
    return spark.createDataFrame([(i, t, a, r, c, u, v, "t0") for i, t, a, r, c, u, v in rows], "sf_id long, title string, abstract string, relevance int, has_code boolean, code_url string, verified boolean, created_at string")


def ids(spark, rows):
    return spark.createDataFrame([(*r, "s", 1.0) for r in rows], "sf_id long, id_type string, id_value string, source string, confidence double")


def test_identifiers_first_wins_and_unknown_papers(spark):
    p = papers(spark, [(1, "A", "", 0, False, "", False), (2, "B", "", 0, False, "", False)])
    old = ids(spark, [(1, "arxiv", "2301.11167")])
    new = spark.createDataFrame([(2, "arxiv", "2301.11167", "s", 1.0, 0), (2, "doi", "d", "s", 1.0, 2), (1, "doi", "d", "s", 1.0, 1), (9, "doi", "e", "s", 1.0, 3)], "sf_id long, id_type string, id_value string, source string, confidence double, ordinal long")
    got = {(r.id_type, r.id_value): r.sf_id for r in store.add_identifiers(old, new, p).collect()}
    assert got == {("arxiv", "2301.11167"): 1, ("doi", "d"): 1}


def test_verify_is_sticky_and_counts_types(spark):
    p = papers(spark, [(1, "A", "", 0, False, "", False), (2, "B", "", 0, False, "", True), (3, "C", "", 0, False, "", False)])
    i = ids(spark, [(1, "arxiv", "a"), (1, "doi", "b"), (3, "arxiv", "c"), (3, "arxiv", "d")])
    assert {r.sf_id: r.verified for r in store.verify_papers(p, i).collect()} == {1: True, 2: True, 3: False}
    stats = {r.name: r.n for r in store.store_stats(store.verify_papers(p, i), i).collect()}
    assert stats == {"papers": 3, "verified": 2, "has_code": 0, "identifiers": 4, "id:arxiv": 3, "id:doi": 1}
    row = audit.store_audit(p, i).first()
    assert (row.total, row.verified, row.dual, row.verified_ratio) == (3, 1, 1, 0.3333)
    empty = audit.store_audit(p.limit(0), i.limit(0)).first()
    assert (empty.total, empty.verified_ratio, empty.dual_ratio) == (0, 0.0, 0.0)


def test_ensure_fills_blanks_and_raises_relevance(spark):
    p = papers(spark, [(1, "A", "", 50, False, "", False), (2, "", "x", 10, False, "u", False)])
    n = spark.createDataFrame([(1, "Z", "abs", 20, "code"), (2, "T", "y", 90, "other"), (3, "N" * 600, "M" * 3000, 5, "")], "sf_id long, title string, abstract string, relevance int, code_url string")
    got = {r.sf_id: r for r in store.ensure_papers(p, n.withColumn("has_code", F.lit(False))).collect()}
    assert (got[1].title, got[1].abstract, got[1].relevance, got[1].code_url, got[1].has_code) == ("A", "abs", 50, "code", True)
    assert (got[2].title, got[2].abstract, got[2].relevance, got[2].code_url, got[2].has_code) == ("T", "x", 90, "u", False)
    assert (len(got[3].title), len(got[3].abstract)) == (500, 2000)


def test_upsert_and_update(spark):
    p = papers(spark, [(1, "A", "", 1, False, "", False)])
    new = papers(spark, [(1, "B", "", 2, True, "", False), (5, "C", "", 3, False, "", False)]).withColumn("created_at", F.lit("t1"))
    got = {r.sf_id: (r.title, r.created_at) for r in store.upsert_papers(p, new).collect()}
    assert got == {1: ("B", "t0"), 5: ("C", "t1")}
    up = store.update_papers(p, spark.createDataFrame([(1, 77, "no")], "sf_id long, relevance int, title string")).first()
    assert (up.relevance, up.title) == (77, "A")
    assert store.update_papers(p, spark.createDataFrame([(1, "no")], "sf_id long, title string")) is p


def test_with_ids_are_unique(spark):
    rec = papers(spark, [(0, f"T{i}", "", 0, False, "", False) for i in range(300)]).withColumn("ordinal", F.col("title"))
    got = [r.sf_id for r in store.with_ids(rec, 1728000001000, 3).collect()]
    assert len(set(got)) == 300 and {x >> 6 & 63 for x in got} == {3} and min(x & 63 for x in got) == 5 and max(x & 63 for x in got) == 63


def test_resolve_ids(spark):
    i = ids(spark, [(1, "arxiv", "9999.99999"), (1, "doi", "10.9999/test"), (2, "isbn", "x")])
    probes = spark.createDataFrame([("9999.99999",), ("see arXiv:9999.99999v2",), ("10.9999/test",), ("x",), ("nothing",)], "probe string")
    assert {r.probe: r.sf_id for r in store.resolve_ids(probes, i).collect()} == {"9999.99999": 1, "see arXiv:9999.99999v2": 1, "10.9999/test": 1, "x": 2}


def test_export(spark, tmp_path):
    p = papers(spark, [(1, "A", "z" * 600, 0, True, "", False), (2, "B", "", 0, False, "", False)])
    i = ids(spark, [(1, "doi", "d"), (1, "arxiv", "a")])
    store.export(p, i, str(tmp_path / "j"))
    rows = {json.loads(r.value)["sf_id"]: json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()}
    assert [x["type"] for x in rows[1]["identifiers"]] == ["arxiv", "doi"] and len(rows[1]["abstract"]) == 500 and rows[2]["identifiers"] == []
    store.export(p, i, str(tmp_path / "c"), "csv")
    got = spark.read.option("header", True).csv(str(tmp_path / "c")).filter("sf_id = 1").first()
    assert (got.identifiers, got.has_code) == ("arxiv:a; doi:d", "1")
    with pytest.raises(ValueError):
        store.export(p, i, str(tmp_path / "x"), "xml")
    with pytest.raises(ValueError):
        store.export(p.limit(0), i, str(tmp_path / "x"))


def test_state(spark):
    u = spark.createDataFrame([("oai", "running", 10, 5, "d1", "c1", "", 1), ("oai", "done", 7, 1, "d2", "", "", 2)], "source string, status string, fetched long, new long, last_update string, checksum string, error string, ordinal long")
    s = store.accumulate_state(u)
    r = s.first()
    assert (r.status, r.total_fetched, r.total_new, r.checksum) == ("done", 17, 6, "c1")
    again = store.set_status(s, spark.createDataFrame([("oai", "failed", "boom"), ("new", "running", "")], "source string, status string, error string"))
    got = {x.source: x for x in again.collect()}
    assert (got["oai"].status, got["oai"].total_fetched, got["oai"].checksum, got["oai"].error) == ("failed", 17, "c1", "boom")
    assert got["new"].total_fetched == 0


def test_publish(spark, tmp_path):
    df = spark.range(3)
    keyed.publish(df, str(tmp_path / "s"))
    keyed.publish(keyed.current(spark, str(tmp_path / "s")).union(spark.range(3, 5)), str(tmp_path / "s"))
    assert keyed.current(spark, str(tmp_path / "s")).count() == 5


def results(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ordinal long, priority int, arxiv_id string, title string, doi string")


def test_session_dedup(spark):
    r = results(spark, [(1, "2301.00001", "A", ""), (1, "2301.00001", "A duplicate", ""), (1, "2301.00002", "B", ""), (1, "", "C", "10.1/x"), (2, "", "D", "10.1/x"), (1, "", "E", ""), (1, "bad", "F", "")])
    assert sorted(x.title for x in dedup.session_dedup(r).collect()) == ["A", "B", "C"]
    # A result that fails its title check leaves the paper to a later source.
    index = spark.createDataFrame([("2301.00001", "Fourier neural operators")], "arxiv_id string, title string")
    r = results(spark, [(1, "2301.00001", "Something else", ""), (2, "2301.00001", "Fourier Neural Operators!", "")])
    got = dedup.session_dedup(r, index).collect()
    assert [(x.priority, x.title) for x in got] == [(2, "Fourier neural operators")]


def test_keep_first_and_known(spark):
    r = results(spark, [(1, "2301.00001", "A", ""), (1, "2301.00002", "B", ""), (1, "2301.00003", "C", "")])
    assert sorted(x.title for x in keyed.keep_first(r.union(r)).collect()) == ["A", "B", "C"]
    one, two = r.filter("title = 'A'"), r.filter("title <> 'C'")
    assert [x.title for x in dedup.exclude_known(r, one, two).collect()] == ["C"]
    assert {x.title: x.reason for x in dedup.known_reason(r, one, two).collect()} == {"A": "arxiv_meta=2301.00001", "B": "paper_store=2301.00002", "C": ""}
    plan = dedup.exclude_known(r, one, two)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "Cartesian" not in plan


def test_queue(spark):
    q = spark.createDataFrame([(1, 70, "pending"), (2, 40, "pending"), (3, 10, "pending"), (4, 90, "done"), (5, 70, "pending")], "sf_id long, relevance int, download_status string")
    i = ids(spark, [(1, "arxiv", "2001.00001"), (2, "arxiv", "9901.00001"), (3, "arxiv", "x"), (4, "arxiv", "2001.00004"), (5, "arxiv", "2001.00005"), (5, "doi", "d")])
    assert [r.sf_id for r in queueing.pull(q, i, "P0").collect()] == [5, 1]
    assert [(r.sf_id, r.arxiv_year) for r in queueing.pull(q, i, "P1").collect()] == [(2, 2099)]
    assert [r.sf_id for r in queueing.pull(q, i, "P2").collect()] == [5, 1, 2, 3]
    assert {r.status: r.n for r in queueing.status_counts(q).collect()} == {"pending": 4, "downloading": 0, "done": 1, "failed": 0}
    stems = spark.createDataFrame([("2001.00001",)], "arxiv_id string")
    assert {r.sf_id: r.download_status for r in queueing.backfill_done(q, i, stems).collect()}[1] == "done"


def test_audit(spark):
    m = spark.createDataFrame([("a", "oai", "1"), ("b", "kaggle", "2"), ("c", "", "3"), ("d", "kaggle", "4")], "arxiv_id string, source string, imported_at string")
    assert {r.source: r.n for r in audit.import_stats(m).collect()} == {"oai": 1, "kaggle": 2, "unknown": 1}
    assert [r.source for r in audit.import_stats(m.drop("source")).collect()] == ["legacy"]
    e = spark.createDataFrame([(1, "a", "dl", "b1", "done"), (2, "a", "dl", "", "failed"), (3, "b", "cv", "b2", "done")], "id long, arxiv_id string, event string, batch_id string, status string")
    assert audit.latest_batch(e).first()[0] == "b2"
    assert {r.event: (r.n, r.failures) for r in audit.event_stats(e).collect()} == {"dl": (2, 1), "cv": (1, 0)}
    assert [r.id for r in audit.query_events(e, arxiv_id="a").collect()] == [2, 1]


INDEX = [
    (1, "Promising directions of machine learning for partial differential equations", "S. Brunton", "we cite other work", "2024-06-28"),
    (2, "Fourier Neural Operator for Parametric Partial Differential Equations", "Zongyi Li", "x", "2020-10-15"),
    (3, "Physics-informed neural networks: A deep learning framework", "M. Raissi", "builds on Fourier Neural Operator for Parametric Partial Differential Equations", "2017-11-28"),
]


def test_check_citations(spark):
    index = spark.createDataFrame(INDEX, "doc_id long, title string, authors string, abstract string, update_date string")
    c = spark.createDataFrame([(1, INDEX[1][1], "Li", 2020), (2, "Nonexistent paper about unicorns", "", 0), (3, "", "", 0), (4, "Fourier Neural Operator", "Li", 2020)], "cite_id long, title string, authors_hint string, year_hint int")
    got = audit.check_citations(c, index).collect()
    best = {r.cite_id: r for r in sorted(got, key=lambda r: r.score)}
    assert (best[1].status, best[1].doc_id, best[1].score) == ("VERIFIED", 2, 1.0)
    assert best[2].status == best[3].status == "NOT_FOUND" and best[4].doc_id == 2
    assert {r.doc_id for r in got if r.cite_id == 1} == {2, 3}


def test_merge_tiers(spark):
    a = spark.createDataFrame([(1, 1, "ERROR", "e"), (1, 2, "SUSPECTED", "s"), (1, 3, "VERIFIED", "v"), (2, 1, "NOT_FOUND", ""), (2, 2, "ERROR", "x")], "cite_id long, tier int, status string, detail string")
    assert {r.cite_id: (r.status, r.detail) for r in audit.merge_tiers(a).collect()} == {1: ("VERIFIED", "v"), 2: ("NOT_FOUND", "")}
    assert "citations: 2" in audit.render_report({"VERIFIED": 1, "NOT_FOUND": 1})


def test_trigram_pairs_against_all_pairs(spark):
    import random

    from test_text import grams

    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(2, 25))) for _ in range(25)]
    titles = sorted({b[:k] + x + b[k:] for b in base for k, x in ((0, ""), (3, "z"), (6, "yy"))})
    rows = spark.createDataFrame(list(enumerate(titles)), "rep long, plain string")
    for least in (0.3, 0.4, 0.8):
        got = {(r.a, r.b): r.sim for r in matching.trigram_pairs(rows.withColumn("n", F.lit(1)), least).collect()}
        want = {(i, j): len(x & y) / len(x | y) for i, a in enumerate(titles) for j, b in enumerate(titles) if i < j and (x := grams(a)) and (y := grams(b)) and len(x & y) / len(x | y) >= least}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_code_matching(spark):
    r = spark.createDataFrame([("p", 0, "u", 9), ("p", 1, "v", 150), ("p", 2, "w", 150), ("q", 0, "x", 5)], "arxiv_id string, ordinal int, code_url string, stars long")
    assert {x.arxiv_id: (x.code_url, x.level) for x in matching.best_repository(r).collect()} == {"p": ("v", 5), "q": ("x", 3)}
    t = lambda rows: spark.createDataFrame(rows, "arxiv_id string, code_url string, level int")
    got = matching.tiered_match([t([("p", "a", 1), ("q", "b", 1)]), t([("p", "c", 3), ("q", "d", 2)]), t([("p", "e", 5)])]).collect()
    assert {x.arxiv_id: x.code_url for x in got} == {"p": "c", "q": "d"}


def test_schema_evolution(spark):
    old = spark.createDataFrame([("a", None)], "arxiv_id string, title string")
    assert blank_missing(conform(old, "arxiv_id string, title string, source string, n int")).first().asDict() == {"arxiv_id": "a", "title": "", "source": "", "n": 0}
    assert store.add_columns(store.add_columns(old, {"x": 1}), {"x": 2}).first().x == 1


def test_reports():
    sources = [{"source": "oai", "n": 5, "first_import": "2020", "last_import": "2021"}, {"source": "unknown", "n": 2}]
    states = [{"source": "oai", "status": "done", "total_new": 1234, "error": ""}, {"source": "x", "status": "failed", "total_new": None, "error": "boom"}]
    text = audit.render_full(7, sources, {"total": 7, "verified": 3, "verified_ratio": 0.4286, "dual": 1, "dual_ratio": 0.1429, "has_code": 2}, [{"id_type": "doi", "n": 3}], states, {"exists": True, "size_mb": 1.5, "lines": 10})
    for said in ("[legacy] 2 papers", "[oai] 5 papers", "first import: 2020", "oai: done, 1,234 papers", "error: boom", "10 lines, 1.5 MB", "verified: 3 (42.9 %)", "doi: 3"):
        assert said in text
    assert "no state files" in audit.render_sources(0, []) and "JSON lines: none" in audit.render_sources(0, [])


def test_retries_and_sources(spark):
    t = spark.createDataFrame([(1, 0), (2, 2), (3, 3)], "id long, retries int")
    got = {r.id: (r.retries, r.wait) for r in queueing.requeued(t, spark.createDataFrame([(1,), (1,), (2,), (3,)], "id long"), 3, 1.0, 3.0).collect()}
    assert got == {1: (1, 1.0), 2: (3, 3.0)}
    s = spark.createDataFrame([("b", 2, True), ("a", 1, False), ("c", 1, True)], "source string, priority int, enabled boolean")
    assert [r.source for r in queueing.available(s).collect()] == ["c", "b"] and queueing.plan_tasks(t, s).count() == 6


def test_few_pairs_that_are_no_result_are_compared(spark, sf_dir):
    """Titles of a small vocabulary share frequent trigrams; of 51,282 documents 250 times as many pairs as similar ones were compared before."""
    text = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet").selectExpr("doc_id", "substring(text, 1, 80) as title")
    classes = matching.title_classes(text, "doc_id", "title")
    _, met = matching.trigram_candidates(classes, 0.8)
    n = matching.trigram_pairs(classes, 0.8).count()
    assert n and met.count() <= 2 * n


def test_a_later_title_must_be_better_by_its_place(spark):
    """As the SQL of best_title has it: the second answer's similarity is greater by less than its place costs."""
    wanted = spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz" * 2 + "0123456789")], "cite_id long, title string")
    found = spark.createDataFrame([(1, 0, wanted.first().title + "xq"), (1, 2, wanted.first().title + "x")], "cite_id long, ordinal int, title string")
    plain, placed = matching.best_title(wanted, found).first(), matching.best_title(wanted, found, place=0.02).first()
    assert (plain.ordinal, placed.ordinal) == (2, 0) and placed.sim == plain.sim


def test_near_copies_of_a_title_meet_on_few_keys(spark):
    """A family of titles with a common beginning: pairs of rare trigrams had nearly all of them meet, each dozens of times. A title is told a bounded number of times."""
    import random

    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(6))
    titles = sorted({" ".join(["the common beginning of a family", *(word() for _ in range(6))])[:74] for _ in range(300)})
    titles += [t[:40] + "x" + t[40:] for t in titles[:40]] + [" blank first", "blank first", "ab", "", None]
    rows = spark.createDataFrame(list(enumerate(titles)), "rep long, plain string")
    grams = [{t[i : i + 3] for i in range(len(t) - 2)} if t else set() for t in titles]
    alike = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    for least in (0.6, 0.8, 1.0):
        got = {(r.a, r.b): r.sim for r in matching.trigram_pairs(rows, least, plained=True).collect()}
        want = {(i, j): s for j, y in enumerate(grams) for i, x in enumerate(grams[:j]) if (s := alike(x, y)) >= least}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    told = matching._by_parts(rows.filter("length(plain) > 2"), 0.8)
    assert told.count() == told.distinct().count() <= 200  # of 57,000 pairs; each pair meets once


def test_titles_that_begin_with_a_removed_mark(spark):
    """As the SQL of trigram_pairs_blocked has it, a blank after a removed mark counts: 0.75 with it, 1 if it were trimmed again."""
    papers = spark.createDataFrame([(1, "¿ abcde"), (2, "abcde")], "sf_id long, title string")
    classes = matching.title_classes(papers, "sf_id", "title")
    assert [r.sim for r in matching.trigram_pairs(classes, 0.7, plained=True).collect()] == [0.75] and not matching.trigram_pairs(classes, 0.8, plained=True).collect()


def test_pairs_of_citations_are_scored_by_many_tasks(spark):
    """All pairs were scored by one task, as their bytes are few; and each of a title's copies was scored."""
    cites = spark.createDataFrame([(1, "deep nets", "ann", 2020), (2, "deep nets", "bob", 2011), (3, "none", "", 0)], "cite_id long, title string, authors_hint string, year_hint int")
    index = spark.createDataFrame([(i, "Deep nets" if i < 9 else "Deep nets of all", "", "ann", "2020-01-01") for i in range(12)], "doc_id long, title string, abstract string, authors string, update_date string")
    found = audit.check_citations(cites, index, columns=("title",))
    got = sorted((r.cite_id, -1 if r.doc_id is None else r.doc_id) for r in found.collect())
    assert got == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, -1)]
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
