"""An index of segments against one build of the living documents; blocks that are opened."""

import random

import pytest

from folioforge.operators import segments, versions
from folioforge.operators.fts import Index
from folioforge.operators.segments import Segments

COLUMNS = ("title", "abstract")


def batch(spark, rnd, ids, odd=()):
    word = lambda: rnd.choice(["graph", "graphs", "node", "edge", "field", "flow", "heat"] + [f"w{rnd.randrange(200)}"] * 6)
    rows = [(i, " ".join(word() for _ in range(rnd.randrange(5))), " ".join(word() for _ in range(rnd.randrange(1, 40)))) for i in ids]
    return spark.createDataFrame([*rows, *odd], "doc_id long, title string, abstract string")


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(segments, "BITS", 2)
    monkeypatch.setattr(segments, "OPEN", (3, 10))


QUERIES = ["graph AND flow", "(graph OR heat OR absent) NOT field", "absent AND edge", '"graph node" OR title:edge', "gra* NOT heat"]


@pytest.mark.parametrize("stemmed", [False, True])
def test_batches_with_overlapping_ids_equal_one_build(spark, tmp_path, small_blocks, stemmed):
    rnd = random.Random(8)
    index = Segments(spark, str(tmp_path / "i"), "doc_id", COLUMNS, stemmed, fanout=3)
    with pytest.raises(ValueError, match="no documents"):
        index.search("graph")
    living = {}
    for n, ids in enumerate((range(60), [*range(40, 90), 200], [*range(20, 50), 95], [45, 3])):
        docs = batch(spark, rnd, ids, [(1000 + n, None, None), (2000, "", "graph " * (n + 1))])
        index.add(docs)
        living |= {r.doc_id: r for r in docs.collect()}
        if n == 2:
            assert index.merge() == 1
    whole = Index.build(spark.createDataFrame(list(living.values()), docs.schema), "doc_id", COLUMNS, stemmed)
    for q in QUERIES[:2] if stemmed else QUERIES:
        want = sorted((-round(r.score, 9), r.doc) for r in whole.match(q).collect())[:10]
        seen = []
        got = sorted((-round(r.score, 9), r.doc) for r in index.search(q, 10, lambda *a: seen.append(a)).collect())
        assert got == want, q
    _, state = index.state()
    assert len(state["segments"]) == 2 and sum(s["docs"] for s in state["segments"]) - state["dead_docs"] == len(living)
    both = lambda i: sorted((r.term, r.doc, r.field, r.tf, tuple(r.places)) for r in i.postings.collect())
    assert both(index.index()) == both(whole)
    # Another writer's version stands: this one isn't lost beneath it.
    number, state = index.state()
    versions.publish(spark, index.root, number + 1, state)
    with pytest.raises(versions.Conflict):
        versions.publish(spark, index.root, number + 1, state)


def test_few_blocks_are_opened(spark, tmp_path, small_blocks):
    """Long documents with one hit can't reach the score of short ones with many: their blocks stay shut."""
    rows = [(i, "", "heat " * 5 if i in (17, 203, 777) else "heat " * (i % 5 < 2) + " ".join(f"w{j % 50}" for j in range(60 + i % 9))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, abstract string")
    index = Segments(spark, str(tmp_path / "i"), "doc_id", COLUMNS, stemmed=False)
    index.add(docs)
    seen = []
    got = [(r.doc, round(r.score, 9)) for r in index.search("heat", 3, lambda *a: seen.append(a)).collect()]
    want = sorted((-round(r.score, 9), r.doc) for r in Index.build(docs, "doc_id", COLUMNS, False).match("heat").collect())[:3]
    assert got == [(d, -s) for s, d in want]
    opened, of = seen[0]
    assert of >= 200 and opened <= 13


def test_a_documents_hits_are_made_without_a_shuffle(spark):
    """Before, every occurrence was shuffled to its document, to which it belongs already."""
    from pyspark.sql import functions as F

    from folioforge.operators import fts

    docs = spark.createDataFrame([(1, "b a b", None), (2, "", "A! x, a"), (3, "", "")], "k long, title string, body string")
    index = fts.Index.build(docs, "k", ("title", "body"), stemmed=False)
    assert sorted(map(tuple, index.postings.collect())) == [("a", 1, "title", 1, [1]), ("a", 2, "body", 2, [0, 2]), ("b", 1, "title", 2, [0, 2]), ("x", 2, "body", 1, [1])]
    assert {(r.doc, r.length) for r in index.lengths.collect()} == {(1, 3), (2, 3), (3, 0)}
    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "hashpartitioning" not in plan
    stems = fts.Index.build(docs.withColumn("title", F.lit("things thing")), "k", ("title", "body"), stemmed=True)
    rows = lambda df: sorted((r.term, r.doc, r.field, r.tf, r.places) for r in df.collect())
    assert rows(stems._rows([fts.Atom(("thing",))])) == rows(stems.postings.filter("term = 'thing'")) == [("thing", i, "title", 2, [0, 1]) for i in (1, 2, 3)]


def test_forms_of_a_stem_are_broadcast_whatever_the_vocabulary(spark, monkeypatch):
    """Before, all postings were shuffled to the stems of a vocabulary that is too large for a broadcast."""
    from folioforge.operators import fts

    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 30)) + " thing things other") for i in range(40)], "k long, title string")
    want = sorted(map(tuple, fts.Index.build(docs, "k", ("title",)).match("thing").collect()))
    monkeypatch.setattr(fts, "BROADCAST_ROWS", 0)
    index = fts.Index.build(docs, "k", ("title",))
    rows = index._rows([fts.Atom(("thing",))])
    assert "BroadcastHashJoin" in (plan := rows._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin" not in plan
    assert sorted(map(tuple, index.match("thing").collect())) == want and len(want) == 40


def test_hits_are_dealt_by_block(spark, tmp_path, small_blocks):
    """Hits were shuffled to their term and block and the blocks again to ranges of terms. A block's terms now lie in one file."""
    from pyspark.sql import functions as F

    docs = spark.range(40).selectExpr("id as k", "concat('w', id % 7, ' common x', id) as title").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = Segments(spark, str(tmp_path / "i"), "k", ("title",), stemmed=False)
        index.add(docs)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    blocks = spark.read.parquet(f"{index.root}/{index.state()[1]['segments'][0]['name']}/blocks").withColumn("file", F.input_file_name())
    n = blocks.agg(F.count_distinct("block").alias("blocks"), F.count_distinct("block", "file").alias("places"), F.count_distinct("file").alias("files"), F.sum("n").alias("hits")).first()
    assert n.blocks == n.places and n.files > 1 and n.hits == 120
    assert [r.doc for r in index.search("common NOT w1").select("doc").collect()] == [0, 2, 3, 4, 5, 6, 7, 9, 10, 11]
