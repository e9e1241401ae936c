"""Schemas of tables and payloads. Missing text is '' and missing numbers 0, so predicates read ``doi <> ''``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAPERS = """sf_id bigint, title string, abstract string, year int, source string, venue string, relevance int, has_code boolean,
 code_url string, verified boolean, created_at timestamp, updated_at timestamp, download_status string, convert_status string,
 wiki_synced boolean, failed_reason string, converted_at timestamp, conversion_version string"""
IDENTIFIERS = "id bigint, sf_id bigint, id_type string, id_value string, source string, confidence double, verified_at timestamp"
#: Part of the data model; nothing reads or writes it.
CROSSREF_CACHE = "doi string, payload string, fetched_at timestamp"
ARXIV_META = """arxiv_id string, title string, authors string, abstract string, categories string, doi string, journal_ref string,
 update_date string, source string, imported_at timestamp"""
DOWNLOAD_STATE = "source string, status string, total_fetched bigint, total_new bigint, last_update string, checksum string, error string, extra string"
AUDIT_EVENTS = """id bigint, event_time timestamp, arxiv_id string, event string, batch_id string, phase string, status string,
 duration_s double, version string, meta string"""
SEARCH_RESULT = """ordinal bigint, arxiv_id string, title string, abstract string, source string, source_category string, source_url string,
 code_url string, venue string, doi string, authors string, score double, confidence double"""
SOURCE_PAPER = SEARCH_RESULT + ", reviews array<struct<rating: string, comment: string>>"
CANDIDATE = """arxiv_id string, title string, abstract string, categories array<string>, source string, url string, code_url string,
 relevance int, md5_abstract string"""
CODE_MATCH = "arxiv_id string, code_url string, level int, source string, stars bigint, verified boolean"
TASK = "priority int, query string, category string, `limit` int, retries int"
#: Identifier types in the order in which a bare identifier is tried.
ID_TYPES = ("arxiv", "doi", "openreview", "issn", "pns", "isbn")
#: Columns that an update may set; all others are ignored.
UPDATABLE = ("relevance", "code_url", "venue", "has_code", "year", "abstract", "source")
DOWNLOAD_STATUSES = ("pending", "downloading", "done", "failed")


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly the schema's columns: absent ones as typed nulls, so that old files read as new ones."""
    from pyspark.sql.types import StructType

    return df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)))


def blank_missing(df: DataFrame) -> DataFrame:
    """Null strings as '' and null numbers as 0."""
    zero = {"int": 0, "bigint": 0, "double": 0.0}
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("" if t == "string" else zero[t])).alias(c) if t == "string" or t in zero else F.col(f"`{c}`") for c, t in df.dtypes))
