"""The download queue: tiers, order, transitions and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import DOWNLOAD_STATUSES

#: Sources that a plan admits.
MOST_SOURCES = 10_000


def in_tier(tier: str) -> Column:
    """P0: relevance 60 or more; P1: 30 to 59; P2: whatever is pending, P0 and P1 included."""
    r = F.col("relevance")
    return {"P0": r >= 60, "P1": (r >= 30) & (r < 60), "P2": F.lit(True)}[tier]


def pull(papers: DataFrame, identifiers: DataFrame, tier: str, limit: int | None = None) -> DataFrame:
    """Pending papers of a tier with an arXiv id (one row for each), by relevance, year of the id and whether they have a DOI."""
    ids = identifiers.filter("id_type = 'arxiv'").select("sf_id", F.col("id_value").alias("arxiv_id"))
    dois = identifiers.filter("id_type = 'doi'").select("sf_id").distinct().withColumn("has_doi", F.lit(1))
    waiting = papers.filter((F.col("download_status") == "pending") & in_tier(tier))
    rows = waiting.join(ids, "sf_id").join(dois, "sf_id", "left").withColumn("arxiv_year", tx.arxiv_year(F.col("arxiv_id")))
    ordered = rows.orderBy(F.desc("relevance"), F.desc("arxiv_year"), F.desc_nulls_last("has_doi"), F.asc("sf_id"), F.asc("arxiv_id"))
    return ordered.limit(limit) if limit else ordered


def status_counts(papers: DataFrame, column: str = "download_status", statuses: Sequence[str] = DOWNLOAD_STATUSES) -> DataFrame:
    """A row for each known status, zero included."""
    known = papers.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return known.join(papers.groupBy(F.col(column).alias("status")).agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def mark(papers: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: sf_id, status, reason (one a paper). Unknown ids change nothing; reasons are clipped to 500."""
    c = changes.select("sf_id", F.col("status").alias("__status"), tx.clip(F.col("reason"), 500).alias("__reason"))
    to = {"download_status": F.coalesce("__status", "download_status"), "failed_reason": F.when(F.col("__status").isNull(), F.col("failed_reason")).otherwise(F.coalesce("__reason", F.lit("")))}
    return papers.join(c, "sf_id", "left").select(*(to.get(x, F.col(x)).alias(x) for x in papers.columns))


def status_from_events(events: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """The status that each paper's last event left."""
    return events.groupBy(key).agg(F.max_by("status", F.struct("event_time", "id")).alias("status"))


def backfill_done(papers: DataFrame, identifiers: DataFrame, stems: DataFrame) -> DataFrame:
    """Pending papers whose arXiv id is among the stems of downloaded files (column arxiv_id) are done."""
    have = identifiers.filter("id_type = 'arxiv'").join(stems.withColumnRenamed("arxiv_id", "id_value"), "id_value", "left_semi").select("sf_id").distinct().withColumn("__have", F.lit(True))
    done = F.when(F.col("__have") & (F.col("download_status") == "pending"), "done").otherwise(F.col("download_status"))
    return papers.join(have, "sf_id", "left").select(*(done.alias(c) if c == "download_status" else F.col(c) for c in papers.columns))


def batch_counters(events: DataFrame) -> DataFrame:
    """A row for each batch: downloaded, converted, failed, skipped, synced."""
    yes = lambda c: F.count_if(c)
    e, s = F.col("event"), F.col("status")
    return events.groupBy("batch_id").agg(
        yes((e == "download") & (s == "done")).alias("downloaded"), yes((e == "convert") & (s == "done")).alias("converted"),
        yes(s == "failed").alias("failed"), yes(s == "skipped").alias("skipped"), yes((e == "wiki") & (s == "done")).alias("wiki"),
    )


def task_order(tasks: DataFrame) -> DataFrame:
    """Search tasks by all their fields, least priority number first."""
    return tasks.orderBy("priority", "query", "category", "limit", "retries")


def available(sources: DataFrame) -> DataFrame:
    """Enabled sources in order of priority (least number first), then by name."""
    return sources.filter("enabled").orderBy("priority", "source")


def plan_tasks(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """Every enabled source for every configured query: a product of two small dimensions, the sources' size checked."""
    enabled = sources.filter("enabled")
    if enabled.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources are no small dimension")
    return queries.crossJoin(F.broadcast(enabled))


def requeued(tasks: DataFrame, failed: DataFrame, most: int = 3, base: float = 1.0, longest: float = 60.0) -> DataFrame:
    """tasks (id, retries) that failed (id), again with one more retry and the seconds to wait; beyond ``most`` retries they go."""
    again = tasks.join(failed.select("id").distinct(), "id", "left_semi").withColumn("retries", F.col("retries") + 1).filter(F.col("retries") <= most)
    return again.withColumn("wait", tx.backoff(F.col("retries"), base, longest))


def downloads_sane(files: DataFrame, least: int = 5000) -> DataFrame:
    """Files (status, length) that arrived whole."""
    return files.filter((F.col("status") == 200) & (F.col("length") >= least))
