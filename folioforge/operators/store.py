"""The paper store: papers and their identifiers as DataFrames, changed by rewriting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import ID_TYPES, UPDATABLE
from ..shared import cut
from .keyed import insert_ignore, upsert


def upsert_papers(papers: DataFrame, records: DataFrame) -> DataFrame:
    """Records with sf_id 0 are new and must have been given an id (``with_ids``); others replace all but created_at."""
    return upsert(papers, records, "sf_id", keep=("created_at",))


def with_ids(records: DataFrame, now_ms: int, worker: int, order: str = "ordinal") -> DataFrame:
    """A snowflake id for each record with sf_id 0: 59 to a millisecond, by rank within the order.

    A distributed sort gives every record its partition and place in it; ranks follow from the partitions' sizes, one row each.
    The sorted records are written first, so both readings see the same partitions.
    """
    place = (1 << 33) - 1  # what monotonically_increasing_id counts within a partition
    new = cut(records.filter("sf_id = 0").drop("sf_id").sort(order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = new.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()
    before, starts = 0, []
    for r in sizes:
        starts.append((r["__part"], before))
        before += r["n"]
    offsets = F.broadcast(records.sparkSession.createDataFrame(starts, "__part bigint, __before bigint"))
    rank = F.col("__before") + F.col("__at").bitwiseAND(F.lit(place))
    room = (1 << tx.SEQUENCE_BITS) - tx.FIRST_SEQUENCE
    made = tx.snowflake(F.lit(now_ms) + F.floor(F.col("__rank") / room), F.lit(worker), tx.FIRST_SEQUENCE + F.pmod(F.col("__rank"), F.lit(room)))
    numbered = new.withColumn("__part", part).join(offsets, "__part").withColumn("__rank", rank)
    return records.filter("sf_id <> 0").unionByName(numbered.withColumn("sf_id", made).select(*records.columns))


def update_papers(papers: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: sf_id and columns of UPDATABLE (others are ignored); null leaves a value as it is."""
    use = [c for c in changes.columns if c in UPDATABLE]
    if not use:
        return papers
    new = changes.select("sf_id", *(F.col(c).alias(f"__{c}") for c in use))
    return papers.join(new, "sf_id", "left").select(*(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in use else F.col(c) for c in papers.columns))


def add_identifiers(identifiers: DataFrame, new: DataFrame, papers: DataFrame) -> DataFrame:
    """The first writer of (id_type, id_value) wins; identifiers of papers that don't exist are refused."""
    return insert_ignore(identifiers, new.join(papers.select("sf_id"), "sf_id", "left_semi"), ["id_type", "id_value"])


def verified_ids(identifiers: DataFrame) -> DataFrame:
    """sf_id, n_types of papers with identifiers of two types or more."""
    return identifiers.groupBy("sf_id").agg(F.countDistinct("id_type").alias("n_types")).filter("n_types >= 2")


def verify_papers(papers: DataFrame, identifiers: DataFrame) -> DataFrame:
    """verified turns true with two types of identifiers and never back."""
    yes = verified_ids(identifiers).select("sf_id", F.lit(True).alias("__yes"))
    return papers.join(yes, "sf_id", "left").select(*((F.col("verified") | F.coalesce("__yes", F.lit(False))).alias("verified") if c == "verified" else F.col(c) for c in papers.columns))


def ensure_papers(papers: DataFrame, found: DataFrame) -> DataFrame:
    """found: one row a paper with sf_id (resolved or new) and the columns of papers. Blanks are filled, relevance only rises,
    has_code turns true only when a code address is newly filled; new papers are clipped."""
    n = found.select("sf_id", *(F.col(c).alias(f"__{c}") for c in papers.columns if c != "sf_id" and c in found.columns), F.lit(True).alias("__found"))
    both = papers.withColumn("__old", F.lit(True)).join(n, "sf_id", "full_outer")
    is_new, given = F.col("__old").isNull(), lambda c: F.col(f"__{c}")
    blank = lambda c: (F.col(c) == "") | F.col(c).isNull() if dict(papers.dtypes)[c] == "string" else F.col(c).isNull() | (F.col(c) == 0)

    def merged(c: str) -> Column:
        if c == "sf_id" or f"__{c}" not in n.columns:
            return F.col(c)
        if c == "relevance":
            kept: Column = F.greatest(F.coalesce(F.col(c), F.lit(0)), F.coalesce(given(c), F.lit(0)))
        elif c == "has_code":
            kept = F.coalesce(F.col(c), F.lit(False)) | ((blank("code_url") & (F.coalesce(given("code_url"), F.lit("")) != "")) if "__code_url" in n.columns else F.lit(False))
        elif c in ("verified", "created_at"):
            kept = F.col(c)
        else:
            kept = F.when(blank(c) & given(c).isNotNull(), given(c)).otherwise(F.col(c))
        first = {"title": tx.clip(given(c), 500), "abstract": tx.clip(given(c), 2000)}.get(c, given(c))
        return F.when(is_new, first).otherwise(kept)

    return both.select(*(merged(c).alias(c) for c in papers.columns))


def add_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Columns that df lacks, with a default: running it again changes nothing."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def papers_by_identifier(papers: DataFrame, identifiers: DataFrame, id_type: str, id_value: str | None = None) -> DataFrame:
    keep = identifiers.filter(F.col("id_type") == id_type)
    if id_value is not None:
        keep = keep.filter(F.col("id_value") == id_value)
    return papers.join(keep.select("sf_id", "id_type", "id_value"), "sf_id")


def resolve_ids(probes: DataFrame, identifiers: DataFrame, order: Sequence[str] = ID_TYPES) -> DataFrame:
    """probe -> sf_id: an exact match of any type in order, then the arXiv id, then the DOI that the probe contains.

    A probe is tried under every type at once; the least priority wins, by partial aggregation.
    """
    tries = [(i, t, F.col("probe")) for i, t in enumerate(order)] + [(len(order), "arxiv", tx.arxiv_id(F.col("probe"))), (len(order) + 1, "doi", tx.doi(F.col("probe")))]
    keys = probes.select("probe", F.explode(F.array(*(F.struct(F.lit(i).alias("priority"), F.lit(t).alias("id_type"), v.alias("id_value")) for i, t, v in tries))).alias("t")).select("probe", "t.*").filter("id_value <> ''")
    hit = keys.join(identifiers.select("id_type", "id_value", "sf_id"), ["id_type", "id_value"])
    return hit.groupBy("probe").agg(F.min(F.struct("priority", "sf_id")).alias("m")).select("probe", F.col("m.sf_id").alias("sf_id"), F.col("m.priority").alias("priority"))


def store_stats(papers: DataFrame, identifiers: DataFrame) -> DataFrame:
    """name, n: papers, verified, with code, identifiers, and identifiers of each type."""
    one = papers.agg(F.count(F.lit(1)).alias("papers"), F.count_if("verified").alias("verified"), F.count_if("has_code").alias("has_code"))
    flat = one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, one.columns)), F.array(*one.columns))).alias("name", "n"))
    ids = identifiers.rollup("id_type").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce(F.concat(F.lit("id:"), "id_type"), F.lit("identifiers")).alias("name"), "n")
    return flat.unionByName(ids)


def identifier_lists(identifiers: DataFrame) -> DataFrame:
    """sf_id and its identifiers as a sorted array of (type, value, confidence)."""
    return identifiers.groupBy("sf_id").agg(F.array_sort(F.collect_list(F.struct(F.col("id_type").alias("type"), F.col("id_value").alias("value"), "confidence"))).alias("identifiers"))


def export_rows(papers: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Papers with nested identifiers, abstracts clipped to 500: what the JSON export writes, a line each."""
    return papers.join(identifier_lists(identifiers), "sf_id", "left").withColumn("abstract", tx.clip(F.col("abstract"), 500)).withColumn("identifiers", F.coalesce("identifiers", F.array().cast("array<struct<type:string,value:string,confidence:double>>")))


def export_csv_rows(papers: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Papers with booleans as 0 and 1 and identifiers as ``type:value; type:value``."""
    joined = export_rows(papers, identifiers)
    return joined.select(
        *(F.col(c).cast("int").alias(c) if t == "boolean" else F.col(c) for c, t in papers.dtypes),
        F.concat_ws("; ", F.transform("identifiers", lambda x: F.concat_ws(":", x["type"], x["value"]))).alias("identifiers"),
    )


def export(papers: DataFrame, identifiers: DataFrame, path: str, kind: str = "json") -> None:
    """Newest first, in parallel files of JSON lines or CSV; an empty store or another format is an error."""
    if kind not in ("json", "csv"):
        raise ValueError(f"unknown format {kind!r}")
    if papers.isEmpty():
        raise ValueError("the store is empty")
    rows = (export_rows if kind == "json" else export_csv_rows)(papers, identifiers)
    rows = rows.orderBy(F.desc("created_at"), "sf_id")
    rows.write.json(path) if kind == "json" else rows.write.option("header", True).csv(path)


def accumulate_state(updates: DataFrame) -> DataFrame:
    """download_state from increments: counters add up; the last non-empty checksum and error stay; status is the last."""
    last = lambda c: F.coalesce(F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("ordinal"))), F.lit(""))
    return updates.groupBy("source").agg(
        F.max_by("status", "ordinal").alias("status"), F.sum("fetched").alias("total_fetched"), F.sum("new").alias("total_new"), F.max("last_update").alias("last_update"), last("checksum").alias("checksum"), last("error").alias("error")
    )


def set_status(state: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: source, status, error. Counters and checksum stay as they are; an unknown source begins at zero."""
    c = changes.select("source", F.col("status").alias("__status"), F.col("error").alias("__error"))
    both = state.join(c, "source", "full_outer")
    zero = {"total_fetched": 0, "total_new": 0, "checksum": "", "last_update": "", "extra": ""}
    return both.select(*(F.coalesce(f"__{x}", x).alias(x) if x in ("status", "error") else F.coalesce(x, F.lit(zero[x])).alias(x) if x in zero else F.col(x) for x in state.columns))


def library_entries(payload: DataFrame) -> DataFrame:
    """payload: rows with the JSON text of {"papers": {id: {...}}}, and ``file`` where there are several. file, ordinal, arxiv_id and the
    JSON of each entry."""
    file = F.col("file") if "file" in payload.columns else F.lit(0)
    return payload.select(file.alias("file"), F.posexplode(F.map_entries(F.from_json(F.get_json_object("json", "$.papers"), "map<string,string>"))).alias("ordinal", "e")).select("file", "ordinal", F.col("e.key").alias("arxiv_id"), F.col("e.value").alias("paper"))


def list_library(payload: DataFrame, newest: int = 20, category: str = "") -> DataFrame:
    """The last ``newest`` entries of the last files, last first; of a category, those whose categories contain it in any case."""
    each = library_entries(payload)
    if category:
        each = each.filter(F.lower(F.get_json_object("paper", "$.categories")).contains(category.lower()))
    return each.orderBy(F.desc("file"), F.desc("ordinal")).limit(newest)


def library_info(payload: DataFrame, arxiv_id: str) -> DataFrame:
    """The entry of one paper, or no row."""
    return library_entries(payload).filter(F.col("arxiv_id") == arxiv_id).select("arxiv_id", "paper")


def system_stats(payload: DataFrame, pdf: DataFrame, md: DataFrame) -> DataFrame:
    """One row: entries of the library, files of either kind (stems), and the library's date of crawling."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    date = payload.agg(F.coalesce(F.max(F.get_json_object("json", "$.crawl_date")), F.lit("")).alias("crawl_date"))
    return n(library_entries(payload), "total_papers").crossJoin(n(pdf, "pdf_files")).crossJoin(n(md, "md_files")).crossJoin(date)
