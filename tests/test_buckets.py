"""Tables in hash buckets: what a change reads and leaves alone, two writers, a writer that dies, a stream."""

import pytest
from pyspark.sql import functions as F

from folioforge.operators import buckets, versions
from folioforge.operators.buckets import Buckets
from folioforge.streaming import jobs

SCHEMA = "k bigint, v string, made string"


def rows(spark, pairs, made="then"):
    return spark.createDataFrame([(k, v, made) for k, v in pairs], SCHEMA)


def told(store):
    return sorted(map(tuple, store.read().collect()))


@pytest.fixture
def store(spark, tmp_path):
    s = Buckets(spark, str(tmp_path / "t"), SCHEMA, ["k"], 32)
    s.upsert(rows(spark, [(i, f"v{i}") for i in range(2000)]))
    return s


def test_untouched_buckets_keep_their_files(spark, store):
    before = {b: store.read([b]).inputFiles() for b in range(32)}
    got = store.upsert(rows(spark, [(5, "new"), (-1, "first")], "now"), keep=["made"])
    assert len(got["touched"]) <= 2 and got["folders_read"] <= 2 < got["folders"]
    for b in range(32):
        same = store.read([b]).inputFiles() == before[b]
        assert same == (b not in got["touched"])
    after = dict((k, (v, made)) for k, v, made in told(store))
    assert after[5] == ("new", "then") and after[-1] == ("first", "now") and len(after) == 2001 and after[7] == ("v7", "then")
    assert Buckets(spark, store.root, SCHEMA, ["k"], 99).buckets == 32
    assert store.upsert(rows(spark, []))["touched"] == [] and len(told(store)) == 2001


def test_last_change_of_a_key_and_first_insertion(spark, store):
    many = spark.range(3000).selectExpr("case when id % 3 = 0 then 1 else id % 7 end as k", "cast(id as string) as v", "'x' as made", "id as ordinal")
    store.upsert(many, order="ordinal")
    assert dict((k, v) for k, v, _ in told(store))[1] == "2997"
    store.insert(spark.range(3000).selectExpr("-1 - id % 5 as k", "cast(id as string) as v", "'x' as made", "id as ordinal"))
    assert {k: v for k, v, _ in told(store) if k < 0} == {-1 - i: str(i) for i in range(5)} and len(told(store)) == 2005


def test_two_writers_cannot_both_win(spark, store, monkeypatch):
    number, state = versions.latest(spark, store.root)
    versions.publish(spark, store.root, number + 1, state)
    with pytest.raises(versions.Conflict):
        versions.publish(spark, store.root, number + 1, {"folders": {}})
    # A writer that is overtaken starts again: both changes are there.
    other, publish, calls = Buckets(spark, store.root, SCHEMA, ["k"]), versions.publish, []

    def overtaken(*a):
        calls.append(a[2])
        if len(calls) == 1:
            monkeypatch.setattr(buckets.versions, "publish", publish)
            other.upsert(rows(spark, [(3, "theirs"), (4, "theirs")]))
        publish(*a)

    monkeypatch.setattr(buckets.versions, "publish", overtaken)
    store.upsert(rows(spark, [(3, "mine")]))
    after = dict((k, v) for k, v, _ in told(store))
    assert after[3] == "mine" and after[4] == "theirs" and len(after) == 2000


def test_a_writer_that_dies_leaves_the_table(spark, store, monkeypatch):
    before = told(store)
    monkeypatch.setattr(buckets.versions, "publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        store.upsert(rows(spark, [(3, "x")]))
    monkeypatch.undo()
    assert told(store) == before
    assert store.vacuum() >= 1 and told(store) == before


def test_stream_reads_its_own_buckets(spark, store, tmp_path):
    for i, keys in enumerate(([1, 5000], [5000, 5001, 5001], [2])):
        spark.createDataFrame([(k, f"s{i}", "s") for k in keys], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.into_buckets(stream, store, str(tmp_path / "c"), report=lambda i, t: seen.append(t)).awaitTermination()
    assert len(seen) == 3 and all(t["folders_read"] <= 6 < t["folders"] for t in seen)
    after = dict((k, v) for k, v, _ in told(store))
    assert after[1] == "v1" and after[2] == "v2" and set(after) == {*range(2000), 5000, 5001}
    for i in range(10):
        store.insert(rows(spark, [(9000 + i, "x")]).withColumn("ordinal", F.lit(1)))
    held = told(store)
    assert store.compact(1) and told(store) == held and store.compact(1) == [] and store.vacuum() > 0 and told(store) == held
