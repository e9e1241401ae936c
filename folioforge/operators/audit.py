"""Statistics of imports and events, and the audit of citations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.similarity import citation_scores, title_ratio
from ..shared import small


def import_stats(meta: DataFrame) -> DataFrame:
    """source, n, first and last import; a blank source is unknown, a table without the column legacy."""
    source = F.when(F.coalesce(F.col("source"), F.lit("")) == "", "unknown").otherwise(F.col("source")) if "source" in meta.columns else F.lit("legacy")
    return meta.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n"), F.min("imported_at").alias("first_import"), F.max("imported_at").alias("last_import"))


def dual_ids(identifiers: DataFrame, first: str = "arxiv", second: str = "doi") -> DataFrame:
    """Papers that have identifiers of both types."""
    return identifiers.filter(F.col("id_type").isin(first, second)).groupBy("sf_id").agg(F.bool_or(F.col("id_type") == first).alias("a"), F.bool_or(F.col("id_type") == second).alias("b")).filter("a and b").select("sf_id")


def ratio_of(part: Column, whole: Column) -> Column:
    """Four places; 0 of nothing."""
    return F.coalesce(F.round(F.try_divide(part, whole), 4), F.lit(0.0))


def store_audit(papers: DataFrame, identifiers: DataFrame) -> DataFrame:
    """One row: totals, papers with both identifiers and the shares of papers verified and dual."""
    dual = dual_ids(identifiers).withColumn("__dual", F.lit(True))
    row = papers.select("sf_id", "verified").join(dual, "sf_id", "left").agg(F.count(F.lit(1)).alias("total"), F.count_if("verified").alias("verified"), F.count_if("__dual").alias("dual"))
    return row.select("*", ratio_of(F.col("verified"), F.col("total")).alias("verified_ratio"), ratio_of(F.col("dual"), F.col("total")).alias("dual_ratio"))


def event_stats(events: DataFrame) -> DataFrame:
    """event, n, failures."""
    return events.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "failed").alias("failures"))


def query_events(events: DataFrame, arxiv_id: str = "", event: str = "", batch_id: str = "", since=None, limit: int = 50) -> DataFrame:
    """The newest events that fit every parameter given."""
    for c, v in (("arxiv_id", arxiv_id), ("event", event), ("batch_id", batch_id)):
        if v:
            events = events.filter(F.col(c) == v)
    if since is not None:
        events = events.filter(F.col("event_time") >= since)
    return events.orderBy(F.desc("id")).limit(limit)


def batch_summary(events: DataFrame, batch_id: str | None = None) -> DataFrame:
    rows = events if batch_id is None else events.filter(F.col("batch_id") == batch_id)
    return rows.groupBy("batch_id", "event", "status").agg(F.count(F.lit(1)).alias("n"))


def latest_batch(events: DataFrame) -> DataFrame:
    """The batch of the last event that has one."""
    return events.filter("batch_id <> ''").agg(F.max_by("batch_id", "id").alias("batch_id"))


def append_events(events: DataFrame, new: DataFrame, version: str = "1") -> DataFrame:
    """new: with meta as a struct or map, which becomes JSON; version and time have defaults."""
    filled = new.withColumn("meta", F.to_json("meta") if dict(new.dtypes)["meta"] != "string" else F.col("meta"))
    if "version" not in new.columns:
        filled = filled.withColumn("version", F.lit(version))
    return events.unionByName(filled, allowMissingColumns=True)


def by_category(results: DataFrame) -> DataFrame:
    """Results by their first category."""
    first = F.coalesce(F.nullif(F.try_element_at("categories", F.lit(1)), F.lit("")), F.lit("unknown"))
    return results.groupBy(first.alias("category")).agg(F.count(F.lit(1)).alias("n"))


# ---- citations -------------------------------------------------------------------------------------------------------


def extract(texts: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each citation in each text."""
    return texts.select(key, F.posexplode(tx.citations(F.col(text))).alias("ordinal", "c")).select(key, "ordinal", "c.*")


def title_tokens(x: Column) -> Column:
    return F.filter(F.split(tx.normalized_title(x), " "), lambda w: w != "")


def phrase_candidates(citations: DataFrame, index: DataFrame, columns: Sequence[str] = ("title", "abstract")) -> DataFrame:
    """cite_id, doc_id of index rows in which a citation's whole title stands as a phrase, in any of the columns.

    A blocked join: index rows meet a citation only on a window of three tokens of its title (all of it, if shorter), the
    rarest of its windows; the phrase is then verified. Of an index row only its id and the hashes of its windows take part, and
    they leave it only if some citation has them; bodies are fetched for the few rows that meet a citation.
    """
    want = citations.select("cite_id", title_tokens(F.col("title")).alias("t")).filter("size(t) > 0").withColumn("n", F.least(F.size("t"), F.lit(3)))
    windows = F.when(F.col("n") == 1, _windows(F.col("t"), 1)).when(F.col("n") == 2, _windows(F.col("t"), 2)).otherwise(_windows(F.col("t"), 3))
    keys = want.select("cite_id", F.concat(F.lit(" "), F.concat_ws(" ", "t"), F.lit(" ")).alias("phrase"), F.explode(windows).alias("key"))
    sizes = sorted(r[0] for r in want.select("n").distinct().collect())  # 1, 2 and 3 at most
    if not sizes:
        return citations.sparkSession.createDataFrame([], "cite_id bigint, doc_id bigint")
    of = lambda c: tx.let(title_tokens(F.col(c)), lambda t: F.concat(*(_windows(t, n) for n in sizes)))
    held = index.select("doc_id", F.explode(F.array_distinct(F.concat(*map(of, columns)))).alias("key"))
    seen = held.join(small(keys.select("key").distinct()), "key", "left_semi")
    weight = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rare = keys.join(weight, "key", "left").groupBy("cite_id", "phrase").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("m")).select("cite_id", "phrase", F.col("m.key").alias("key"))
    met = seen.join(rare, "key").select("cite_id", "phrase", "doc_id").distinct()
    body = F.concat(F.lit(" "), F.concat_ws(" | ", *(F.concat_ws(" ", title_tokens(F.col(c))) for c in columns)), F.lit(" "))
    return index.select("doc_id", *columns).join(met, "doc_id").filter(body.contains(F.col("phrase"))).select("cite_id", "doc_id")


def _windows(t: Column, n: int) -> Column:
    """Hashes of the windows of n tokens. t: a column or variable that is computed once."""
    hashed = lambda w, i: F.xxhash64(F.lit(n), w, *(F.get(t, i + k) for k in range(1, n)))
    return F.slice(F.transform(t, hashed), F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(0)))


def best_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key. A task passes on that many of a key at most, before the shuffle and after it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= most).drop("__rank")


def check_citations(citations: DataFrame, index: DataFrame, top: int = 3, columns: Sequence[str] = ("title", "abstract")) -> DataFrame:
    """citations: cite_id, title, authors_hint, year_hint. The best ``top`` matches of each with score and status.

    Without a match one row says NOT_FOUND. The year is that of update_date. Citations that say the same are looked up once, their
    phrases once a title, and of a citation's matches, however many, each task passes ``top`` on. Where titles alone are looked up,
    rows that agree in all that is scored score alike: the ``top`` least ids of them stand for all.
    """
    said = F.struct(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("authors_hint", F.lit("")).alias("authors_hint"), F.coalesce("year_hint", F.lit(0)).alias("year_hint"))
    asked = citations.groupBy(said.alias("said")).agg(F.min("cite_id").alias("cite_id")).select("cite_id", "said.*")
    if set(columns) <= {"title"}:
        index = best_rows(index.select("doc_id", "title", "authors", "update_date"), ["title", "authors", "update_date"], [F.asc("doc_id")], top)
    titles = asked.groupBy("title").agg(F.min("cite_id").alias("cite_id"))
    pairs = phrase_candidates(titles, index, columns).join(titles, "cite_id").select("title", "doc_id")
    hit = pairs.join(asked, "title").join(index.select("doc_id", F.col("title").alias("found"), F.col("authors").alias("found_authors"), tx.year_of(F.col("update_date")).alias("found_year")), "doc_id")
    # Pairs are few bytes but dear to score, so they are dealt by number: by size they would be one task.
    session = citations.sparkSession
    hit = hit.repartition(max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))), "cite_id", "doc_id")
    scored = hit.withColumn("score", citation_scores("title", "found", "year_hint", "found_year", "authors_hint", "found_authors"))
    best = best_rows(scored.select("cite_id", "doc_id", "found", "score"), ["cite_id"], [F.desc("score"), F.asc("doc_id")], top)
    answers = asked.join(best, "cite_id", "left").select(F.struct("title", "authors_hint", "year_hint").alias("said"), "doc_id", "found", "score")
    rows = citations.select("cite_id", said.alias("said")).join(answers, "said")
    return rows.select("cite_id", "doc_id", "found", F.coalesce("score", F.lit(0.0)).alias("score"), tx.status_of(F.coalesce("score", F.lit(0.0))).alias("status"))


def remote_matches(queries: DataFrame, candidates: DataFrame, query_first: bool = True, least: float = 0.70) -> DataFrame:
    """queries: cite_id, title; candidates: cite_id, ordinal, title of at most a few answers each. The best of each.

    A candidate counts if its ratio is ``least`` or more, or if either title contains the other, then at 0.70. query_first
    says in which order the two titles are compared: the ratio depends on it.
    """
    both = queries.withColumnRenamed("title", "wanted").join(candidates, "cite_id")
    a, b = tx.normalized_title(F.col("wanted")), tx.normalized_title(F.col("title"))
    scored = both.withColumn("sim", title_ratio("wanted", "title") if query_first else title_ratio("title", "wanted")).filter((a != "") & (b != ""))
    sim = F.when(F.col("sim") >= least, F.col("sim")).when(a.contains(b) | b.contains(a), F.lit(0.70))
    kept = scored.withColumn("sim", sim).filter("sim is not null")
    return kept.groupBy("cite_id").agg(F.min(F.struct((-F.col("sim")).alias("o"), "ordinal", "title", "sim")).alias("m")).select("cite_id", "m.ordinal", "m.title", "m.sim")


#: Fixed order: the better status first.
STATUS_ORDER = ("VERIFIED", "SUSPECTED", "NOT_FOUND", "ERROR")


def merge_tiers(answers: DataFrame) -> DataFrame:
    """answers: cite_id, tier, status, detail. The best status; the detail of the first verified tier, else of the first
    without error. An error in one tier doesn't end the search in the next."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status")), F.lit(9))
    detail = F.when((F.col("status") != "ERROR") & (F.coalesce("detail", F.lit("")) != ""), F.struct((F.col("status") != "VERIFIED").alias("o"), "tier", "detail"))
    return answers.groupBy("cite_id").agg(F.min_by("status", F.struct(rank, "tier")).alias("status"), F.min(detail).alias("d")).select("cite_id", "status", F.coalesce("d.detail", F.lit("")).alias("detail"))


def report_totals(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def render_report(totals: dict[str, int], title: str = "Citation audit") -> str:
    """Text of a report over a few collected totals."""
    n = sum(totals.values())
    return "\n".join([title, "=" * len(title), f"citations: {n}", *(f"{s:<10} {totals[s]:>8}  {100 * totals[s] / n if n else 0:5.1f} %" for s in STATUS_ORDER if s in totals)])


def _source_lines(sources: Sequence[Mapping]) -> list[str]:
    out = []
    for s in sources:
        out.append(f"  [{'legacy' if s['source'] == 'unknown' else s['source']}] {s['n']:,} papers")
        out += [f"    {label}: {s[key]}" for label, key in (("first import", "first_import"), ("last import", "last_import")) if s.get(key)]
    return out


def _state_lines(states: Sequence[Mapping]) -> list[str]:
    return [f"  {s['source']}: {s['status']}, {s.get('total_new') or 0:,} papers" + (f", error: {s['error']}" if s.get("error") else "") for s in states] or ["  no state files"]


def _jsonl_line(jsonl: Mapping | None) -> str:
    return f"JSON lines: {jsonl['lines']:,} lines, {jsonl['size_mb']} MB" if jsonl and jsonl.get("exists") else "JSON lines: none"


def render_sources(total: int, sources: Sequence[Mapping], states: Sequence[Mapping] = (), jsonl: Mapping | None = None, time: str = "") -> str:
    """Text of the report on data sources, over collected rows of import_stats, state files and jsonl_info."""
    return "\n".join(["Data source audit", f"time: {time}", f"total: {total:,} papers", "sources:", *_source_lines(sources), "state files:", *_state_lines(states), _jsonl_line(jsonl)])


def render_store(row: Mapping, types: Sequence[Mapping] = ()) -> str:
    """Text on the quality of the store, over the row of store_audit (and has_code) and counts by identifier type."""
    lines = [f"papers: {row['total']:,}", f"verified: {row['verified']:,} ({100 * row['verified_ratio']:.1f} %)", f"with code: {row.get('has_code') or 0:,}", f"both identifiers: {row['dual']:,} ({100 * row['dual_ratio']:.1f} %)"]
    return "\n".join(["Paper store", *(f"  {x}" for x in lines), "  identifiers:", *(f"    {t['id_type']}: {t['n']:,}" for t in types)])


def render_full(total: int, sources: Sequence[Mapping], store: Mapping, types: Sequence[Mapping] = (), states: Sequence[Mapping] = (), jsonl: Mapping | None = None, time: str = "") -> str:
    """Both reports in one."""
    return render_sources(total, sources, states, jsonl, time) + "\n\n" + render_store(store, types)
