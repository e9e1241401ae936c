"""The bound of words that the quality classifier learns from."""

import numpy as np
from pyspark.sql import functions as F

from folioforge.llm import quality_model
from test_text_operators import table


def test_a_long_document_keeps_out_no_other(spark):
    texts = [f"good words {i} in a row." if i % 2 else "BAD!! " * 9 for i in range(80)]
    df = table(spark, texts)
    first = df.orderBy(F.xxhash64("doc_id"), "doc_id").first().doc_id
    long = df.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("word "), 5000)).otherwise(F.col("text")))
    labels = df.select("doc_id", (F.col("text").startswith("good")).cast("int").alias("quality"))
    model = quality_model.fit(long, labels, F.lit(True), train_words=2000)
    score = model.score(["good words 7 in a row.", "BAD!! " * 9])
    assert score[0] > 0.5 > score[1] and np.isfinite(score).all()
    tiny = quality_model.fit(long, labels, F.lit(True), train_words=1)  # a word of one document: scores all the same
    assert np.isfinite(tiny.score(["good words 7 in a row.", ""])).all()


def test_scores_dont_depend_on_neighbours(spark):
    texts = ["good words in a row.", "row. row good", "", None, "good", "good good BAD!!", "words words in a row.", "x" * 3000] + [f"good words {i} in a row." if i % 2 else "BAD!! " * 9 for i in range(80)]
    df = table(spark, texts)
    labels = df.select("doc_id", (F.coalesce("text", F.lit("")).startswith("good")).cast("int").alias("quality"))
    model = quality_model.fit(df, labels, F.lit(True))
    alone = [float(model.score([x or ""])[0]) for x in texts]
    assert model.score([x or "" for x in texts]).tolist() == alone and model.score([x or "" for x in texts[::-1]]).tolist() == alone[::-1]
    rows = lambda d: sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in quality_model.scores(d, model).collect())
    assert rows(df) == rows(df.repartition(7)) == rows(df.orderBy(F.desc("text")).coalesce(1))
    again = quality_model.fit(df.repartition(5), labels.repartition(3), F.lit(True))
    assert again.score([x or "" for x in texts]).tolist() == alone


def test_long_labelled_texts_stay_off_the_driver(spark):
    """Forty texts of 200,000 words under a bound of 1,000: of a long one a run of words is read, and no length keeps a document out."""
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40, F.repeat(F.lit("word "), 200_000)).when(F.col("id") % 2 == 0, F.lit("good words in a row.")).otherwise(F.lit("BAD!! BAD!!")).alias("text"))
    labels = df.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    seen = []
    few = quality_model._few
    quality_model._few = lambda d, ids: (seen.append(r) or r for r in few(d, ids))
    try:
        model = quality_model.fit(df, labels, F.lit(True), train_words=1000)
    finally:
        quality_model._few = few
    assert sum(r.n for r in seen) <= 1000 + 1000 // quality_model.LONG and max(len(r.buckets) for r in seen) == 4 * (1000 // quality_model.LONG)
    order = [r.doc_id for r in df.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    assert sorted(r.doc_id for r in seen) == sorted(order[: len(seen)]) and np.isfinite(model.score(["good words in a row."])).all()


def test_one_huge_labelled_text(spark):
    """Learnt from as the others are."""
    rows = [(i, "good words in a row. " * (50_000 if i == 0 else 1) if i % 2 == 0 else "BAD!! BAD!! BAD!!") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    score = quality_model.fit(df, labels, F.lit(True), train_words=4000).score(["good words in a row.", "BAD!! BAD!!"])
    assert score[0] > 0.5 > score[1]
