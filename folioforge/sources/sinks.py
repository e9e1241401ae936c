"""Sinks beside the store's export: candidate lists, front matter, log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip
from ..operators.keyed import ranked


def write_candidates(papers: DataFrame, root: str, stamp: str) -> None:
    """Best relevance first, abstracts clipped to 300, under a stamped name and as the latest. ``rank`` tells each one's place, since files
    written side by side keep no order. The sort runs once."""
    rows = ranked(papers.withColumn("abstract", clip(F.col("abstract"), 300)), F.desc("relevance"), F.asc("arxiv_id"))
    rows.write.mode("overwrite").json(f"{root}/candidates_{stamp}")
    papers.sparkSession.read.schema(rows.schema).json(f"{root}/candidates_{stamp}").write.mode("overwrite").json(f"{root}/candidates_latest")


def front_matter(head: Column, body: Column) -> Column:
    """A document with its fields as JSON between rules."""
    return F.concat(F.lit("---\n"), F.to_json(head), F.lit("\n---\n\n"), body)


def log_line(*fields: Column) -> Column:
    """A JSON object; null fields are left out."""
    return F.to_json(F.struct(*fields))


def write_documents(docs: DataFrame, root: str, wiki: str | None = None) -> None:
    """docs: arxiv_id, head (a struct), body. A document with front matter each, below root and, if given, also below the wiki's folder."""
    made = docs.select("arxiv_id", front_matter(F.col("head"), F.col("body")).alias("value"))
    for path in [root, *([wiki] if wiki else [])]:
        made.write.mode("overwrite").parquet(path)
