"""Deduplication of search results and exclusion of what is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .keyed import first_by


def union_sources(*sources: tuple[int, DataFrame]) -> DataFrame:
    """All results with (priority, ordinal) of where they came from; lower priority numbers come first."""
    out = None
    for priority, df in sources:
        one = df.withColumn("priority", F.lit(priority))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def verified_titles(results: DataFrame, index: DataFrame, least: float = 0.40) -> DataFrame:
    """Results whose identifier the index knows must resemble its title, which then replaces theirs; others pass."""
    known = index.select("arxiv_id", F.col("title").alias("__title"))
    both = results.join(known, "arxiv_id", "left")
    compared = (F.coalesce(F.col("title"), F.lit("")) != "") & (F.coalesce(F.col("__title"), F.lit("")) != "")
    passed = both.filter(~compared | (tx.jaccard(tx.trigrams(F.col("title")), tx.trigrams(F.col("__title"))) >= least))
    return passed.select(*(F.when(compared, tx.clip(F.col("__title"), 200)).otherwise(F.col("title")).alias("title") if c == "title" else F.col(c) for c in results.columns))


def session_dedup(results: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The first result of each identifier: a valid arXiv id, else a DOI; without either it goes. A result that fails its title
    check is dropped before, so a later source may still supply the paper."""
    key = F.when(tx.is_arxiv_id(F.col("arxiv_id")), F.concat(F.lit("arxiv:"), "arxiv_id")).when(F.coalesce(F.col("doi"), F.lit("")) != "", F.concat(F.lit("doi:"), "doi"))
    keyed = (results if index is None else verified_titles(results, index)).withColumn("__key", key).filter("__key is not null")
    return first_by(keyed, ["__key"], ["priority", "ordinal"]).drop("__key")


def exclude_known(results: DataFrame, index: DataFrame, store_ids: DataFrame) -> DataFrame:
    """Results that neither the index nor the store has."""
    return results.join(index.select("arxiv_id"), "arxiv_id", "left_anti").join(store_ids.select("arxiv_id"), "arxiv_id", "left_anti")


def known_reason(results: DataFrame, index: DataFrame, store_ids: DataFrame) -> DataFrame:
    """Results with why they are known: arxiv_meta before paper_store, '' for new ones."""
    mark = lambda df, c: df.select("arxiv_id").distinct().withColumn(c, F.lit(True))
    both = results.join(mark(index, "__i"), "arxiv_id", "left").join(mark(store_ids, "__s"), "arxiv_id", "left")
    return both.select(*results.columns, F.when(F.col("__i"), F.concat(F.lit("arxiv_meta="), "arxiv_id")).when(F.col("__s"), F.concat(F.lit("paper_store="), "arxiv_id")).otherwise("").alias("reason"))


def content_groups(papers: DataFrame, key: str, text: str) -> DataFrame:
    """key, md5 of the text, least key with the same text, and how many have it: by partial aggregation and a join, so that a
    text which a third of all rows share is no one task's burden."""
    hashed = papers.select(key, F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("md5"))
    groups = hashed.groupBy("md5").agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    return hashed.join(groups, "md5").select(key, "md5", "first_id", "n_copies")
