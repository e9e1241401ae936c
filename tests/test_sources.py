"""Readers on small payloads, the search index, streams."""

import json

import pytest
from pyspark.sql import functions as F

from folioforge.operators import fts
from folioforge.sources import readers, sinks
from folioforge.streaming import jobs


def payload(spark, *objects):
    return spark.createDataFrame([(json.dumps(o),) for o in objects], "json string")


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"2301.00001","title":"T","authors":["A","B"],"categories":["x","y"],"journal-ref":"J"}\n\n{bad\n{"title":"no id"}\n{"id":"solv-int/9901001v2","title":null}\n')
    got = {r.arxiv_id: r for r in readers.json_lines(spark, str(tmp_path / "a.jsonl")).collect()}
    assert set(got) == {"2301.00001", "solv-int/9901001v2"} and got["solv-int/9901001v2"].title == ""
    got = {r.arxiv_id: r for r in readers.kaggle_lines(spark, str(tmp_path / "a.jsonl")).collect()}
    assert (got["2301.00001"].authors, got["2301.00001"].categories, got["2301.00001"].journal_ref) == ("A, B", "x y", "J") and "9901001" in got
    info = readers.jsonl_info(spark, str(tmp_path / "a.jsonl")).first()
    assert info.exists and info.lines == 5


def test_oai(spark, tmp_path):
    one = "<record><header>{}<identifier>i</identifier></header><metadata><arXiv><id>{}</id><title>{}</title><abstract>{}</abstract><version><date>2023-01-02T00:00</date></version></arXiv></metadata></record>"
    (tmp_path / "p.xml").write_text("<r>" + one.format("", "2301.00001", "T", "a" * 900) + one.format("<status>deleted</status>", "2301.00002", "D", "") + one.format("", "math/0101", "Old", "") + one.format("", "2301.00004", "", "") + '<record><header status="deleted"><identifier>j</identifier></header></record></r>')
    got = readers.oai_records(spark, str(tmp_path / "p.xml")).collect()
    assert [(r.arxiv_id, len(r.abstract), r.update_date) for r in got] == [("2301.00001", 500, "2023-01-02")]


def test_atom(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<feed><entry><id>http://arxiv.org/abs/2301.11167v2</id><title> A\n  B </title><summary>s</summary><author><name>X</name></author><author><name>Y</name></author><category term="cs.LG"/><published>2023-01-01T0</published></entry><entry><id>none</id></entry></feed>')
    r = readers.atom_entries(spark, str(tmp_path / "f.xml")).collect()
    assert [(x.arxiv_id, x.title, x.authors, x.categories) for x in r] == [("2301.11167", "A B", "X, Y", ["cs.LG"])]


def test_service_payloads(spark):
    r = readers.europe_pmc(payload(spark, {"resultList": {"result": [{"title": "T", "journalTitle": "J", "pubYear": "2020", "doi": "d", "hasPDF": "Y", "citedByCount": 42}, {"title": ""}]}})).collect()
    assert [(x.title, x.venue, round(x.confidence, 6)) for x in r] == [("T", "J (2020)", 1.0)]
    r = readers.semantic_scholar(payload(spark, {"data": [{"title": "T", "year": None, "externalIds": {"ArXiv": "2503.11111", "DOI": "d"}, "openAccessPdf": {"url": "u"}, "journal": {"name": "J"}, "authors": [{"name": str(i)} for i in range(7)], "citationCount": 88}, {"title": "U"}]})).collect()
    assert [(x.arxiv_id, x.venue, x.authors) for x in r] == [("2503.11111", "J", "0, 1, 2, 3, 4"), ("", "", "")]
    r = readers.crossref_works(payload(spark, {"message": {"items": [{"DOI": "d", "title": ["T"], "container-title": ["V"], "issued": {"date-parts": [[2019, 1]]}, "relation": {"x": [{"id": "arXiv:2010.08895"}]}}]}})).first()
    assert (r.doi, r.title, r.venue, r.year, r.arxiv_id) == ("d", "T", "V", 2019, "2010.08895")
    r = readers.openalex_works(payload(spark, {"results": [{"title": "T", "publication_year": 2020, "doi": "https://doi.org/10.1/x", "primary_location": {"source": {"display_name": "V"}}, "authorships": [{"author": {"display_name": "A"}}]}]})).first()
    assert (r.doi, r.venue, r.authors) == ("10.1/x", "V", "A")
    r = readers.papers_with_code(payload(spark, {"results": [{"url_abs": "https://arxiv.org/abs/2301.00001", "title": "T", "repositories": [{"url": "u", "stars": 5, "is_official": False}, {"url": "v", "stars": 1, "is_official": True}]}]})).first()
    assert (r.arxiv_id, r.code_url) == ("2301.00001", "v")
    r = readers.daily_papers(payload(spark, [{"id": "2301.00001v1", "title": "T"}, {"id": "x"}])).collect()
    assert [x.arxiv_id for x in r] == ["2301.00001"]
    notes = {"notes": [{"forum": "f", "content": {"title": {"value": "N"}, "abstract": "a", "venueid": "ICLR/2024", "html": "https://arxiv.org/abs/2301.00001"}}, {"forum": "f", "invitation": "X/Official_Review", "content": {"recommendation": {"value": "8"}, "comment": "c" * 400}}]}
    n = readers.openreview_notes(payload(spark, notes)).first()
    assert (n.title, n.venue, n.arxiv_id) == ("N", "ICLR", "2301.00001")
    v = readers.openreview_reviews(payload(spark, notes)).collect()
    assert [(x.rating, len(x.comment)) for x in v] == [("8", 300)]
    g = readers.github_repositories(payload(spark, {"items": [{"name": "n", "html_url": "u", "stargazers_count": 3, "owner": {"login": "o"}}]})).first()
    assert (g.owner, g.stars, g.description) == ("o", 3, "")


def test_state_files_and_stems(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/oai_download_state.json").write_text('{"source":"oai","status":"done","total_new":100}')
    (tmp_path / "s/bad_download_state.json").write_text("{invalid json")
    got = {r.source: r for r in readers.state_files(spark, str(tmp_path / "s")).collect()}
    assert got["oai"].total_new == 100 and got["bad"].status.startswith("parse_error")
    (tmp_path / "p").mkdir()
    (tmp_path / "p/2301.00001.pdf").write_bytes(b"x")
    (tmp_path / "p/y.md").write_bytes(b"x")
    assert [r[0] for r in readers.file_stems(spark, str(tmp_path / "p")).collect()] == ["2301.00001"]
    assert readers.candidates(spark, str(tmp_path / "none.json")).count() == 0
    assert readers.setting({"a": {"b": None, "c": 0}}, "a.b", 5) == 5 and readers.setting({"a": {"c": 0}}, "a.c", 5) == 0
    assert readers.read_config(str(tmp_path / "no.yaml")) == {}


def test_sinks(spark, tmp_path):
    one = spark.createDataFrame([("a", None)], "x string, y string")
    assert one.select(sinks.log_line(F.col("x"), F.col("y"))).first()[0] == '{"x":"a"}'
    assert one.select(sinks.front_matter(F.struct("x"), F.lit("body"))).first()[0] == '---\n{"x":"a"}\n---\n\nbody'


def test_query_language():
    p = fts.parse
    assert p("a b OR c").op == "or" and p("a NOT b").op == "not" and p("(a OR b) c").op == "and"
    assert p("physics-informed").atom.terms == ("physics", "informed")
    assert p("title:foo*").atom == fts.Atom(("foo",), True, "title")
    for bad in ("", "(a", "a OR", "nope:x", "NOT a"):
        with pytest.raises(ValueError):
            p(bad, ("title",))


def test_index(spark, tmp_path):
    d = spark.createDataFrame([(1, "red fox", "", "the quick red fox"), (2, "blue", "", "fox red"), (3, "x", "", "")], "id long, title string, authors string, abstract string")
    ix = fts.Index.build(d, "id", stemmed=False)
    ids = lambda i, q: sorted(r.doc for r in i.match(q).collect())
    ix.save(str(tmp_path / "ix"))
    for i in (ix, fts.Index.load(spark, str(tmp_path / "ix"), stemmed=False)):
        assert ids(i, "red fox") == [1, 2] and ids(i, '"red fox"') == [1] and ids(i, "title:red") == [1] and ids(i, "qui*") == [1] and ids(i, "fox NOT quick") == [2] and ids(i, "zzz") == []
    assert ids(fts.Index.build(d.withColumn("title", F.lit("foxes running")), "id"), "fox run") == [1, 2, 3]


def test_stream_into_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    state = {"df": spark.createDataFrame([("a", 0)], "arxiv_id string, v long")}
    seen = []

    def write(df):
        state["df"] = state["df"].union(spark.createDataFrame(df.collect(), df.schema))

    for k, rows in enumerate(([("a", 1), ("b", 2)], [("b", 3), ("c", 4)])):
        (tmp_path / f"in/{k}.json").write_text("".join(json.dumps({"arxiv_id": a, "v": v}) + "\n" for a, v in rows))
        q = jobs.into_store(jobs.pages(spark, str(tmp_path / "in"), "arxiv_id string, v long"), lambda: state["df"], write, ["arxiv_id"], str(tmp_path / "cp"), report=lambda *x: seen.append(x))
        q.awaitTermination()
    assert {r.arxiv_id: r.v for r in state["df"].collect()} == {"a": 0, "b": 2, "c": 4} and [x[1] for x in seen] == [2, 2]


def test_stream_windows_and_drain(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/0.json").write_text("".join(json.dumps({"t": f"2024-01-01T00:{m:02d}:00", "event": "e"}) + "\n" for m in (1, 2, 20)))
    s = jobs.pages(spark, str(tmp_path / "in"), "t timestamp, event string")
    got = jobs.to_table(jobs.windowed_counts(s, "t", "10 minutes", "5 minutes"), "complete", str(tmp_path / "cp"), str(tmp_path / "out")).collect()
    assert sorted(r.n for r in got) == [1, 2]
    left = [2, 1, 0]
    assert jobs.drain(lambda: spark.range(left.pop(0)), lambda df: None) == 2


def test_archives(spark, tmp_path):
    """JSON lines before JSON before gzip, within zip archives too."""
    import gzip
    import zipfile

    with pytest.raises(FileNotFoundError):
        (tmp_path / "x").mkdir()
        (tmp_path / "x/readme.txt").write_text("x")
        readers.archive_lines(spark, str(tmp_path / "x"))
    lines = lambda: [r.value for r in readers.archive_lines(spark, str(tmp_path / "x")).collect()]
    (tmp_path / "x/c.json.gz").write_bytes(gzip.compress(b'{"id":"gz"}\n'))
    assert lines() == ['{"id":"gz"}']
    with zipfile.ZipFile(tmp_path / "x/a.zip", "w") as z:
        z.writestr("deep/b.json", '{"id":"1"}\n{"id":"2"}\r\n')
        z.writestr("notes.txt", "no")
    assert lines() == ['{"id":"1"}', '{"id":"2"}']
    with zipfile.ZipFile(tmp_path / "x/b.zip", "w") as z:
        z.writestr("c.jsonl", '{"id":"é"}')
    assert lines() == ['{"id":"é"}']


def test_members_are_unpacked_by_tasks_of_their_own(spark, tmp_path, monkeypatch):
    import zipfile

    (tmp_path / "x/deep").mkdir(parents=True)
    for n in range(3):
        with zipfile.ZipFile(tmp_path / f"x/deep/{n}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for m in range(4):
                z.writestr(f"m{m}.jsonl", "".join(f"{n}-{m}-{i}\n" for i in range(1000)))
            z.writestr("empty.jsonl", "")
    members = readers.archive_members(spark, str(tmp_path / "x"))
    assert members.count() == 15 and {r.bytes for r in members.collect()} == {0, 7890}
    lines = readers.member_lines(members)
    assert sorted(r.value for r in lines.collect()) == sorted(f"{n}-{m}-{i}" for n in range(3) for m in range(4) for i in range(1000))
    of = {}
    for r in lines.select(F.spark_partition_id().alias("task"), "path", "member").distinct().collect():
        of.setdefault(r.task, set()).add((r.path, r.member))
    assert len(of) == 12 and all(len(x) == 1 for x in of.values())
    monkeypatch.setattr(readers, "MOST_TASKS", 2)
    assert readers.member_lines(members).count() == 12_000 and readers.member_lines(members.limit(0)).count() == 0


def test_harvest_by_token(spark):
    """Pages until no token is given; known rows are skipped; most_pages stops early."""
    pages = {None: (["a", "b"], "t1"), "t1": (["b", "c"], "t2"), "t2": (["c", "d"], None), "t3": ([], None)}
    one = lambda ids: spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "arxiv_id string, ordinal long")
    for most, want in ((0, ["a", "b", "c", "d"]), (2, ["a", "b", "c"])):
        state, seen = {"df": one(["a"])}, []
        n = jobs.harvest(lambda t: (one(pages[t][0]), pages[t][1]), lambda s=state: s["df"], lambda df, s=state: s.update(df=s["df"].union(one([r.arxiv_id for r in df.collect()]))), most_pages=most, report=lambda *x, s=seen: s.append(x))
        assert sorted(r.arxiv_id for r in state["df"].collect()) == want and n == len(want) - 1 and seen[0] == (1, 2, 1)
    assert jobs.harvest(lambda t: None, lambda: one([]), lambda df: None) == 0 and jobs.harvest(lambda t: (one([]), "t"), lambda: one([]), lambda df: None) == 0


def test_stems_are_made_of_the_vocabulary_once(spark):
    """A query's plan runs no UDF, and finds what stems of plain Python find."""
    from folioforge.functions.stem import stem

    texts = {1: "Relational models, trained", 2: "a training of the model", 3: "nothing", 4: None, 5: ""}
    docs = spark.createDataFrame(list(texts.items()), "id bigint, title string")
    found = fts.Index.build(docs, "id", ("title",)).match("model AND train")
    want = [k for k, x in texts.items() if {"model", "train"} <= {stem(w.strip(",").lower()) for w in (x or "").split()}]
    assert sorted(r["doc"] for r in found.collect()) == want == [1, 2]
    assert "EvalPython" not in found._jdf.queryExecution().executedPlan().toString()


def test_files_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """As Spark's readers do, without its index of all files on the driver."""
    for name, text in {"a b.pdf": "x", "1/c+d.pdf": "yy", "1/2/e.pdf": "é", "1/f.md": "z", ".g.pdf": "h", "_h/i.pdf": "h", "1/_j.pdf": "h", "1/empty.pdf": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    told = lambda rows: sorted((r.path.rpartition("/")[2], r.md5, r.length) for r in rows.collect())
    plain = {deep: told(spark.read.format("binaryFile").option("recursiveFileLookup", deep).load(str(tmp_path)).selectExpr("path", "md5(content) as md5", "length")) for deep in (True, False)}
    monkeypatch.setattr(type(spark), "read", property(lambda self: pytest.fail("the driver lists files")))
    for deep in (True, False):
        assert told(readers.file_checksums(spark, str(tmp_path), recursive=deep)) == plain[deep]
    assert sorted(r[0] for r in readers.file_stems(spark, f"file://{tmp_path}").collect()) == ["a b", "c+d", "e"]
    assert {r.value for r in readers.whole_texts(spark, str(tmp_path), recursive=True).collect()} == {"x", "yy", "é", "z"}
