"""Bibliographic tables derived from the tables at hand, in Spark and, by the same expressions, in SQL.

Every row of a source table takes part. Titles are clipped to 80 characters, as a catalogue's are; texts stay whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ARXIV = "concat(lpad(cast(13 + doc_id % 12 as string), 2, '0'), lpad(cast(1 + floor(doc_id / 100000) % 12 as string), 2, '0'), '.', lpad(cast(doc_id % 100000 as string), 5, '0'))"


def papers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").selectExpr(
        "doc_id as sf_id", f"{_ARXIV} as arxiv_id", "substring(text, 1, 80) as title", "text as abstract", "cast(2015 + doc_id % 11 as int) as year", "source", "lang",
        "concat(lang, ' ', source) as categories", "concat(cast(2015 + doc_id % 11 as string), '-01-01') as update_date", "n_chars % 101 as relevance", "n_chars % 3 = 0 as has_code",
        "case when lang = 'en' then concat('J. ', source) else '' end as journal_ref", "concat(source, ', ', lang) as authors",
    )


PAPERS = """papers as (select doc_id as sf_id, lpad(cast(13 + doc_id % 12 as varchar), 2, '0') || lpad(cast(1 + (doc_id // 100000) % 12 as varchar), 2, '0') || '.' || lpad(cast(doc_id % 100000 as varchar), 5, '0') as arxiv_id,
 substring(text, 1, 80) as title, text as abstract, cast(2015 + doc_id % 11 as integer) as year, source, lang, lang || ' ' || source as categories, cast(2015 + doc_id % 11 as varchar) || '-01-01' as update_date,
 n_chars % 101 as relevance, n_chars % 3 = 0 as has_code, case when lang = 'en' then 'J. ' || source else '' end as journal_ref, source || ', ' || lang as authors from documents)"""


def identifiers(spark: SparkSession, d: str) -> DataFrame:
    """An arXiv id but for French papers, a DOI for labelled ones, an OpenReview id for those of a source that ends in 7."""
    p = papers(spark, d)
    doi = p.join(read(spark, d, "labels").select(F.col("doc_id").alias("sf_id")).distinct(), "sf_id", "left_semi")
    return (
        p.filter("lang <> 'fr'").selectExpr("sf_id", "'arxiv' as id_type", "arxiv_id as id_value")
        .unionAll(doi.selectExpr("sf_id", "'doi' as id_type", "concat('10.1000/', cast(sf_id as string)) as id_value"))
        .unionAll(p.filter("source like '%7'").selectExpr("sf_id", "'openreview' as id_type", "concat('or', cast(sf_id as string)) as id_value"))
        .selectExpr("*", "'derived' as source", "1.0D as confidence")
    )


IDENTIFIERS = """identifiers as (select sf_id, 'arxiv' as id_type, arxiv_id as id_value from papers where lang <> 'fr'
 union all select sf_id, 'doi', '10.1000/' || cast(sf_id as varchar) from papers where sf_id in (select doc_id from labels)
 union all select sf_id, 'openreview', 'or' || cast(sf_id as varchar) from papers where source like '%7')"""


def with_doi(spark: SparkSession, d: str) -> DataFrame:
    """Papers with the column doi ('' without one)."""
    doi = identifiers(spark, d).filter("id_type = 'doi'").select("sf_id", F.col("id_value").alias("doi"))
    return papers(spark, d).join(doi, "sf_id", "left").withColumn("doi", F.coalesce("doi", F.lit("")))


META = "meta as (select p.*, coalesce(i.id_value, '') as doi from papers p left join identifiers i on i.sf_id = p.sf_id and i.id_type = 'doi')"


def results(spark: SparkSession, d: str) -> DataFrame:
    """Search results of three sources: English papers first (1), labelled ones (15), then all (100)."""
    from ..operators.dedup import union_sources

    p = with_doi(spark, d).select("arxiv_id", "title", "doi", F.col("sf_id").alias("ordinal"), "lang")
    base = p.select("arxiv_id", "title", "doi", "ordinal")
    return union_sources((1, p.filter("lang = 'en'").drop("lang").withColumn("title", F.concat(F.lit("local "), "title"))), (15, base.filter("doi <> ''")), (100, base))


RESULTS = """results as (select arxiv_id, 'local ' || title as title, doi, sf_id as ordinal, 1 as priority from meta where lang = 'en'
 union all select arxiv_id, title, doi, sf_id, 15 from meta where doi <> '' union all select arxiv_id, title, doi, sf_id, 100 from meta)"""


def events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").selectExpr(
        "event_id as id", "ts as event_time", "cast(user_id as string) as arxiv_id", "event_type as event", "date_format(ts, 'yyyy-MM-dd') as batch_id",
        "case when event_type = 'error' then 'failed' else 'done' end as status", "value as duration_s", "props as meta",
    )


EVENTS = """ev as (select event_id as id, ts as event_time, cast(user_id as varchar) as arxiv_id, event_type as event, strftime(ts, '%Y-%m-%d') as batch_id,
 case when event_type = 'error' then 'failed' else 'done' end as status, value as duration_s, props as meta from events)"""


def queue(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as queued papers, and their identifiers: an arXiv id each, a DOI for those with more than three lines."""
    o = read(spark, d, "orders").selectExpr("o_orderkey as sf_id", "case o_orderstatus when 'P' then 'pending' when 'F' then 'done' else 'failed' end as download_status", "cast(floor(o_totalprice) as bigint) % 101 as relevance")
    ids = o.selectExpr("sf_id", "'arxiv' as id_type", "concat(lpad(cast(sf_id % 100 as string), 2, '0'), '01.', lpad(cast(sf_id % 100000 as string), 5, '0')) as id_value")
    doi = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sf_id")).count().filter("count > 3").selectExpr("sf_id", "'doi' as id_type", "concat('10.1000/', cast(sf_id as string)) as id_value")
    return o, ids.unionAll(doi)


QUEUE = """q as (select o_orderkey as sf_id, case o_orderstatus when 'P' then 'pending' when 'F' then 'done' else 'failed' end as download_status, cast(floor(o_totalprice) as bigint) % 101 as relevance from orders),
 qids as (select sf_id, 'arxiv' as id_type, lpad(cast(sf_id % 100 as varchar), 2, '0') || '01.' || lpad(cast(sf_id % 100000 as varchar), 5, '0') as id_value from q
 union all select l_orderkey, 'doi', '10.1000/' || cast(l_orderkey as varchar) from lineitem group by l_orderkey having count(*) > 3)"""


def sql(body: str, *parts: str) -> str:
    """A statement over the derived tables that it needs."""
    return f"with {', '.join(parts)} {body}" if parts else body
