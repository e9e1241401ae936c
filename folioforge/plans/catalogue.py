"""The registered queries over search, the store, deduplication, queues, audits and matching, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import audit, dedup, fts, matching, queueing, store
from ..shared import cut, folder
from ..sources import readers
from ..streaming import jobs
from . import bindings as b

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


P, I, M, R, E, Q = b.PAPERS, b.IDENTIFIERS, b.META, b.RESULTS, b.EVENTS, b.QUEUE

# ---- search ----------------------------------------------------------------------------------------------------------

_FIELDS = ("title", "authors", "abstract")
_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_INDEX = (
    f"w as (select sf_id, arxiv_id, update_date, categories, {_TOKENS.format('title')} as t0, {_TOKENS.format('authors')} as t1, {_TOKENS.format('abstract')} as t2 from papers), "
    "sizes as (select sf_id, len(t0) + len(t1) + len(t2) as len from w), whole as (select count(*) as n, avg(len) as mean from sizes)"
)


def _count(term: str) -> str:
    return " + ".join(f"len(list_filter(t{i}, lambda x: {term}))" for i in range(3))


def _fts_sql(counts: list[str], where: str, tail: str, scored: list[int] | None = None, columns: str = "sf_id, round(raw, 6) as score", filters: str = "true") -> str:
    scored = list(range(len(counts))) if scored is None else scored
    tf = ", ".join(f"cast({c} as double) as tf{i}" for i, c in enumerate(counts))
    df = ", ".join(f"count(*) filter (where tf{i} > 0) as df{i}" for i in range(len(counts)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in scored)
    return b.sql(f"select {columns} from (select f.*, {score} as raw from f cross join g cross join whole join sizes using (sf_id) where {where}) where {filters} {tail}", P, _INDEX, f"f as (select sf_id, arxiv_id, update_date, categories, {tf} from w)", f"g as (select {df} from f)")


def _index(spark: SparkSession, d: str) -> tuple[fts.Index, DataFrame]:
    p = b.papers(spark, d)
    return fts.Index.build(p, "sf_id", _FIELDS, stemmed=False), p.select("sf_id", "update_date", "categories")


def _scored(df: DataFrame) -> DataFrame:
    return df.select("sf_id", F.round("score", 6).alias("score"))


@query(_fts_sql([_count("x = 'der'"), _count("x = 'ein'")], "tf0 > 0 and tf1 > 0", "order by raw desc, sf_id limit 10"))
def fts_bm25_topk(spark, d):
    """Ten best documents with both terms."""
    index, meta = _index(spark, d)
    return _scored(fts.search(index, meta, "sf_id", "der ein", 10))


@query(_fts_sql([" + ".join(f"len(list_filter(list_zip(t{i}, t{i}[2:]), lambda x: x[1] = 'the' and x[2] = 'and'))" for i in range(3))], "tf0 > 0", ""))
def fts_phrase(spark, d):
    """All documents with the phrase."""
    index, _ = _index(spark, d)
    return index.match('"the and"').select(F.col("doc").alias("sf_id"), F.round("score", 6).alias("score"))


@query(_fts_sql([_count("x[1:5] = 'thing'"), _count("x = 'der'"), _count("x = 'that'")], "(tf0 > 0 or tf1 > 0) and not tf2 > 0", "", scored=[0, 1]))
def fts_prefix_or_not(spark, d):
    """A prefix or a term, without another term."""
    index, _ = _index(spark, d)
    return index.match("(thing* OR der) NOT that").select(F.col("doc").alias("sf_id"), F.round("score", 6).alias("score"))


@query(_fts_sql([_count("x = 'der'")], "tf0 > 0", "order by raw desc, sf_id limit 20", filters="cast(substring(update_date, 1, 4) as integer) between 2017 and 2022 and (list_contains(string_split(categories, ' '), 'src1') or list_contains(string_split(categories, ' '), 'src2'))"))
def fts_filtered_year_cat(spark, d):
    """Filters first, then the limit."""
    index, meta = _index(spark, d)
    return _scored(fts.search(index, meta, "sf_id", "der", 20, 2017, 2022, ["src1", "src2"]))


@query(_fts_sql([_count("x = 'the'")], "tf0 > 0", "order by update_date desc, sf_id limit 20", columns="sf_id, update_date"))
def fts_sort_date(spark, d):
    index, meta = _index(spark, d)
    return fts.search(index, meta, "sf_id", "the", 20, sort="date").select("sf_id", "update_date")


@query(None)
def fts_stemmed(spark, d):
    """With Porter stems in index and query."""
    index = fts.Index.build(b.papers(spark, d), "sf_id", _FIELDS, stemmed=True)
    return index.match("thing OR attion AND the").select(F.col("doc").alias("sf_id"), F.round("score", 6).alias("score"))


@query(b.sql("select term, count(*) as n_docs, cast(sum(tf) as bigint) as n from (select sf_id, unnest(x) as term, 1 as tf from (select sf_id, t0 || t1 || t2 as x from w)) group by term", P, _INDEX).replace("count(*) as n_docs", "count(distinct sf_id) as n_docs"))
def inverted_index_terms(spark, d):
    """The whole index, reduced to a row for each term."""
    index, _ = _index(spark, d)
    return index.postings.groupBy("term", "doc").agg(F.sum("tf").alias("tf")).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("n"))


@query(b.sql("select substring(update_date, 1, 4) as year, count(*) as n, count(*) filter (where doi <> '') as with_doi, count(*) filter (where journal_ref <> '') as with_journal, count(*) filter (where doi <> '' and journal_ref <> '') as with_both from meta group by 1", P, I, M))
def index_stats_by_year(spark, d):
    m = b.with_doi(spark, d)
    has_doi, has_j = F.col("doi") != "", F.col("journal_ref") != ""
    return m.groupBy(F.substring("update_date", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_if(has_doi).alias("with_doi"), F.count_if(has_j).alias("with_journal"), F.count_if(has_doi & has_j).alias("with_both"))


@query(b.sql("select count(*) as total, count(*) filter (where doi <> '') as with_doi, count(*) filter (where journal_ref <> '') as with_journal, count(*) filter (where doi <> '' and journal_ref <> '') as with_both from meta", P, I, M))
def index_stats(spark, d):
    return fts.index_stats(b.with_doi(spark, d))


@query(b.sql("select sf_id, relevance from papers where title ilike '%er%th%' or abstract ilike '%er%th%' order by relevance desc, update_date desc, sf_id limit 50", P))
def keyword_like_search(spark, d):
    """% in the keyword is a wildcard; case doesn't matter."""
    return fts.keyword_search(b.papers(spark, d).withColumn("created_at", F.col("update_date")), "er%th").select("sf_id", "relevance")


@query(b.sql("select sf_id from papers where (try_cast(substring(update_date, 1, 4) as integer) is null or try_cast(substring(update_date, 1, 4) as integer) between 2018 and 2020) and (list_contains(string_split(categories, ' '), 'de') or list_contains(string_split(categories, ' '), 'src3'))", P))
def year_category_filter(spark, d):
    return b.papers(spark, d).filter(tx.in_years(F.col("update_date"), 2018, 2020) & tx.has_category(F.col("categories"), ["de", "src3"])).select("sf_id")


# ---- relevance -------------------------------------------------------------------------------------------------------

HIGH, MEDIUM, LOW, PHRASES, EXCLUDED = ("thble", "thtion"), ("attion", "thing"), ("the",), ("of the", "the and"), ("erble",)
_TEXT = "lower(title || chr(10) || abstract)"
_KW = "least(100, " + " + ".join(f"case when contains({_TEXT}, '{w}') then {n} else 0 end" for ws, n in ((HIGH, 20), (MEDIUM, 10), (LOW, 5)) for w in ws) + ")"
_PH = "least(80, " + " + ".join(f"case when contains({_TEXT}, '{w}') then 15 else 0 end" for w in PHRASES) + ")"
_REL = f"case when {_KW} >= 60 then {_KW} else least(100, greatest({_KW}, {_PH})) end"


@query(b.sql(f"select sf_id, cast({_REL} as integer) as relevance from papers", P))
def relevance_score(spark, d):
    return b.papers(spark, d).select("sf_id", tx.relevance(F.col("title"), F.col("abstract"), HIGH, MEDIUM, LOW, PHRASES).alias("relevance"))


@query(b.sql(f"select sf_id, cast(r as integer) as relevance from (select sf_id, case when contains({_TEXT}, 'erble') then 0 else {_REL} end as r from papers) where r >= 30", P))
def relevance_pass_blacklist(spark, d):
    return b.papers(spark, d).select("sf_id", tx.relevance(F.col("title"), F.col("abstract"), HIGH, MEDIUM, LOW, PHRASES, EXCLUDED).alias("relevance")).filter("relevance >= 30")


@query(b.sql(f"select sf_id, cast(least(5, floor(1 + {' + '.join([f'case when contains({_TEXT}, {chr(39)}{w}{chr(39)}) then {n} else 0 end' for ws, n in ((HIGH, 1.0), (MEDIUM, 0.5)) for w in ws])})) as integer) as stars from papers", P))
def legacy_score_1_5(spark, d):
    text = F.lower(F.concat("title", F.lit("\n"), "abstract"))
    return b.papers(spark, d).select("sf_id", tx.stars_1_to_5(text, HIGH, MEDIUM).alias("stars"))


@query(b.sql("select doc_id, md5(lower(text)) as text_hash, case when list_contains(string_split(lang, ' '), 'en') then 'en' else 'other' end as category from documents"))
def unified_record_fields(spark, d):
    docs = b.read(spark, d, "documents")
    return docs.select("doc_id", F.md5(F.lower("text").cast("binary")).alias("text_hash"), F.when(tx.has_category(F.col("lang"), ["en"]), "en").otherwise("other").alias("category"))


@query(b.sql("select arxiv_id, substring(title, 1, 200) as title, substring(abstract, 1, 500) as abstract, 'https://arxiv.org/abs/' || arxiv_id as source_url, doi, journal_ref as venue, case when doi <> '' and journal_ref <> '' then 0.9::double when doi <> '' then 0.6::double else 0.3::double end as confidence, case when abstract = '' then '' else md5(abstract) end as md5_abstract from meta", P, I, M))
def result_records(spark, d):
    return fts.result_record(b.with_doi(spark, d))


# ---- titles ----------------------------------------------------------------------------------------------------------

_NORM = r"lower(trim(regexp_replace(regexp_replace({}, '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')))"


@query(b.sql(f"select {_NORM.format('title')} as title, count(*) as n, min(sf_id) as first_id from papers group by 1", P))
def title_normalize_exact(spark, d):
    """Titles that are equal once normalised."""
    return b.papers(spark, d).groupBy(tx.normalized_title(F.col("title")).alias("title")).agg(F.count(F.lit(1)).alias("n"), F.min("sf_id").alias("first_id"))


_PLAIN = r"regexp_replace(lower(trim(title)), '[^a-z0-9\s]', '', 'g')"
_TRI = "case when len(plain) < 3 then [] else list_distinct(list_transform(range(1, len(plain) - 1), lambda i: substring(plain, cast(i as integer), 3))) end"


@query(b.sql("select x.rep as a, y.rep as b, x.n as n_a, y.n as n_b, round(len(list_intersect(x.t, y.t)) / cast(len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)) as double), 6) as sim from c x join c y on x.rep < y.rep where len(x.t) > 0 and len(y.t) > 0 and len(list_intersect(x.t, y.t)) / cast(len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)) as double) >= 0.8 - 1e-12", P, f"c as (select rep, n, {_TRI} as t from (select {_PLAIN} as plain, min(sf_id) as rep, count(*) as n from papers group by 1))"))
def trigram_pairs_blocked(spark, d):
    """Pairs of distinct titles of 0.8 similarity or more, by their classes' least ids, with the classes' sizes."""
    c = cut(matching.title_classes(b.papers(spark, d), "sf_id", "title"))  # the texts are read once
    n = lambda x: c.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"))
    return matching.trigram_pairs(c, 0.8, plained=True).join(n("a"), "a").join(n("b"), "b").select("a", "b", "n_a", "n_b", F.round("sim", 6).alias("sim"))


@query(None)
def title_ratio_match(spark, d):
    """Each title against two answers, another paper's and its own with marks and case changed, by the sequence ratio."""
    p = b.papers(spark, d)
    wanted = p.select(F.col("sf_id").alias("cite_id"), "title")
    other = p.selectExpr("sf_id as other", "title").join(p.selectExpr("sf_id as cite_id", "sf_id div 2 as other"), "other").select("cite_id", F.lit(0).alias("ordinal"), "title")
    own = wanted.select("cite_id", F.lit(1).alias("ordinal"), F.regexp_replace(F.upper("title"), "[.,]", "!").alias("title"))
    return audit.remote_matches(wanted, other.unionByName(own)).select("cite_id", "ordinal", F.round("sim", 6).alias("sim"))


@query(None)
def citation_score_status(spark, d):
    """Benchmark titles audited against the index."""
    cites = b.read(spark, d, "benchmark").select(F.col("item_id").alias("cite_id"), tx.clip(F.col("text"), 80).alias("title"), F.lit("src1").alias("authors_hint"), F.lit(2018).alias("year_hint"))
    return audit.check_citations(cites, b.papers(spark, d).select(F.col("sf_id").alias("doc_id"), "title", "abstract", "authors", "update_date"))


@query(b.sql(r"select i.cite_id, p.sf_id as doc_id from (select item_id as cite_id, ' ' || " + _NORM.format("substring(text, 1, 80)") + r" || ' ' as phrase from benchmark) i join papers p on contains(' ' || " + _NORM.format("p.abstract") + " || ' ', i.phrase) or contains(' ' || " + _NORM.format("p.title") + " || ' ', i.phrase)", P))
def citation_phrase_candidates(spark, d):
    """Documents in which a benchmark title stands as a phrase."""
    bench = b.read(spark, d, "benchmark").select(F.col("item_id").alias("cite_id"), tx.clip(F.col("text"), 80).alias("title"))
    return audit.phrase_candidates(bench, b.papers(spark, d).select(F.col("sf_id").alias("doc_id"), "title", "abstract"))


_CITED = """cited as (select conv_id, turn, text || ' arXiv:' || lpad(cast(conv_id % 10000 as varchar), 4, '0') || '.' || lpad(cast(turn as varchar), 5, '0') || 'v2 '
 || case (conv_id + turn) % 5 when 0 then '"A title of some length" (Author et al., ' || cast(1990 + conv_id % 30 as varchar) || ')' when 1 then 'Smith & Jones (' || cast(1990 + turn % 30 as varchar) || ') "Its title"'
 when 2 then 'Müller (2019) "no, the name has an umlaut"' when 3 then 'Lee et al. (' || cast(2000 + conv_id % 20 as varchar) || ') ' || chr(8220) || 'curly quotes' || chr(8221) else '"nothing, as the year is short" (Author, 19)' end as t from conversations)"""
_SHAPES = ((tx.TITLE_FIRST, 2, 3, 1), (tx.AUTHOR_FIRST.replace(r"\u201c", "“").replace(r"\u201d", "”"), 1, 2, 3))  # DuckDB knows no such escapes
_PARSED = " union all ".join(f"select conv_id, turn, 'author-year-title' as type, '' as id, trim(regexp_extract(m, '{p}', {a})) as authors, cast(regexp_extract(m, '{p}', {y}) as integer) as year, trim(regexp_extract(m, '{p}', {t})) as title from (select conv_id, turn, unnest(regexp_extract_all(t, '{p}')) as m from cited)" for p, a, y, t in _SHAPES)


@query(b.sql(r"select conv_id, turn, 'arxiv' as type, id, '' as authors, 0 as year, '' as title from (select conv_id, turn, unnest(list_distinct(regexp_extract_all(t, '(\d{4}\.\d{4,5})(?:v\d+)?', 1))) as id from cited) union all " + _PARSED, _CITED))
def citation_extract(spark, d):
    """Citations in every turn, each with an identifier and one of five shapes appended, two of which are none."""
    c = b.read(spark, d, "conversations")
    year = lambda x, base, most: F.concat((base + F.col(x) % most).cast("string"))
    kind, text = (F.col("conv_id") + F.col("turn")) % 5, F.lit
    shaped = (
        F.when(kind == 0, F.concat(text('"A title of some length" (Author et al., '), year("conv_id", 1990, 30), text(")"))).when(kind == 1, F.concat(text("Smith & Jones ("), year("turn", 1990, 30), text(') "Its title"')))
        .when(kind == 2, 'Müller (2019) "no, the name has an umlaut"').when(kind == 3, F.concat(text("Lee et al. ("), year("conv_id", 2000, 20), text(") \u201ccurly quotes\u201d"))).otherwise('"nothing, as the year is short" (Author, 19)')
    )
    whole = F.concat("text", F.lit(" arXiv:"), F.lpad((F.col("conv_id") % 10000).cast("string"), 4, "0"), F.lit("."), F.lpad(F.col("turn").cast("string"), 5, "0"), F.lit("v2 "), shaped)
    return c.select("conv_id", "turn", F.explode(tx.citations(whole)).alias("c")).select("conv_id", "turn", "c.type", "c.id", "c.authors", "c.year", "c.title")


_ANSWERS = "answers as (select item_id as cite_id, t as tier, case when (item_id + t) % 5 = 0 then 'ERROR' when (item_id * 7 + t) % 3 = 0 then 'VERIFIED' when (item_id + t) % 3 = 1 then 'SUSPECTED' else 'NOT_FOUND' end as status, case when (item_id + t) % 2 = 0 then 'd' || cast(t as varchar) else '' end as detail from benchmark, (select unnest([1, 2, 3]) as t))"


def _answers(spark, d):
    s = "case when (item_id + t) % 5 = 0 then 'ERROR' when (item_id * 7 + t) % 3 = 0 then 'VERIFIED' when (item_id + t) % 3 = 1 then 'SUSPECTED' else 'NOT_FOUND' end as status"
    return b.read(spark, d, "benchmark").selectExpr("item_id", "explode(array(1, 2, 3)) as t").selectExpr("item_id as cite_id", "t as tier", s, "case when (item_id + t) % 2 = 0 then concat('d', cast(t as string)) else '' end as detail")


_RANK = "case status when 'VERIFIED' then 1 when 'SUSPECTED' then 2 when 'NOT_FOUND' then 3 else 4 end"


@query(b.sql(f"select cite_id, arg_min(status, {_RANK} * 10 + tier) as status, coalesce(arg_min(detail, case when status = 'VERIFIED' then 0 else 10 end + tier) filter (where status <> 'ERROR' and detail <> ''), '') as detail from answers group by cite_id", _ANSWERS))
def citation_cascade_merge(spark, d):
    return audit.merge_tiers(_answers(spark, d))


@query(b.sql(f"select status, count(*) as n from (select cite_id, arg_min(status, {_RANK} * 10 + tier) as status from answers group by cite_id) group by status", _ANSWERS))
def citation_report_totals(spark, d):
    return audit.report_totals(audit.merge_tiers(_answers(spark, d)))


# ---- identifiers and the store ---------------------------------------------------------------------------------------


@query(b.sql("select l.doi, coalesce(m.arxiv_id, '') as arxiv_id from (select distinct '10.1000/' || cast(item_id as varchar) as doi from benchmark) l left join (select doi, min(arxiv_id) as arxiv_id from meta where doi <> '' group by doi) m using (doi)", P, I, M))
def doi_reverse_lookup(spark, d):
    dois = b.read(spark, d, "benchmark").selectExpr("concat('10.1000/', cast(item_id as string)) as doi").distinct()
    return fts.doi_to_arxiv(dois, b.with_doi(spark, d))


@query(b.sql("""select probe, arg_min(sf_id, cast(priority as bigint) * 1000000000000 + sf_id) as sf_id, cast(min(priority) as integer) as priority from (
 select k.probe, k.priority, i.sf_id from (select probe, 0 as priority, 'arxiv' as id_type, probe as id_value from pr union all select probe, 1, 'doi', probe from pr union all select probe, 2, 'openreview', probe from pr
 union all select probe, 6, 'arxiv', regexp_extract(probe, '(\\d{4}\\.\\d{4,5})(?:v\\d+)?', 1) from pr union all select probe, 7, 'doi', regexp_extract(probe, '10\\.\\d{4,}/[^\\s]+') from pr) k join identifiers i on i.id_type = k.id_type and i.id_value = k.id_value) group by probe""".replace("\\\\", "\\"),
 P, I, "pr as (select 'see arXiv:' || arxiv_id || 'v3' as probe from papers union select '10.1000/' || cast(sf_id as varchar) from papers union select 'or' || cast(sf_id as varchar) from papers)"))
def any_id_resolution(spark, d):
    p = b.papers(spark, d)
    probes = p.selectExpr("concat('see arXiv:', arxiv_id, 'v3') as probe").union(p.selectExpr("concat('10.1000/', cast(sf_id as string))")).union(p.selectExpr("concat('or', cast(sf_id as string))")).distinct()
    return store.resolve_ids(probes, b.identifiers(spark, d))


@query(b.sql("select p.sf_id, p.title, i.id_value from papers p join identifiers i on i.sf_id = p.sf_id where i.id_type = 'openreview'", P, I))
def papers_by_identifier(spark, d):
    return store.papers_by_identifier(b.papers(spark, d), b.identifiers(spark, d), "openreview").select("sf_id", "title", "id_value")


_DUAL = "dual as (select sf_id from identifiers where id_type = 'arxiv' intersect select sf_id from identifiers where id_type = 'doi'), ver as (select sf_id, count(distinct id_type) as n_types from identifiers group by sf_id having count(distinct id_type) >= 2)"


@query(b.sql("select count(*) as total, count(v.sf_id) as verified, count(d.sf_id) as dual, coalesce(round(count(v.sf_id) / nullif(cast(count(*) as double), 0), 4), 0.0) as verified_ratio, coalesce(round(count(d.sf_id) / nullif(cast(count(*) as double), 0), 4), 0.0) as dual_ratio from papers p left join ver v on v.sf_id = p.sf_id left join dual d on d.sf_id = p.sf_id", P, I, _DUAL))
def dual_id_audit(spark, d):
    ids = b.identifiers(spark, d)
    return audit.store_audit(store.verify_papers(b.papers(spark, d).withColumn("verified", F.lit(False)), ids), ids)


@query(b.sql("select sf_id, n_types from ver", P, I, _DUAL))
def verified_papers(spark, d):
    return store.verified_ids(b.identifiers(spark, d))


@query(b.sql("select 'papers' as name, count(*) as n from papers union all select 'verified', count(*) from ver union all select 'has_code', count(*) from papers where has_code union all select 'identifiers', count(*) from identifiers union all select 'id:' || id_type, count(*) from identifiers group by id_type", P, I, _DUAL))
def store_stats(spark, d):
    ids = b.identifiers(spark, d)
    return store.store_stats(store.verify_papers(b.papers(spark, d).withColumn("verified", F.lit(False)), ids), ids)


@query(b.sql("select case when source = 'src3' then 'unknown' else source end as source, count(*) as n, min(update_date) as first_import, max(update_date) as last_import from papers group by 1", P))
def source_import_stats(spark, d):
    """One source is blank and reported as unknown."""
    return audit.import_stats(b.papers(spark, d).select(F.when(F.col("source") == "src3", "").otherwise(F.col("source")).alias("source"), F.col("update_date").alias("imported_at")))


_NEWIDS = "fresh as (select sf_id, 'doi' as id_type, '10.1000/' || cast(n_chars % 2000 as varchar) as id_value, sf_id as ordinal from (select doc_id as sf_id, n_chars from documents))"


@query(b.sql("select sf_id, id_type, id_value from identifiers union all select f.m, 'doi', f.id_value from (select id_value, arg_min(sf_id, ordinal) as m from fresh where ('doi', id_value) not in (select (id_type, id_value) from identifiers) group by id_value) f".replace("('doi', id_value) not in (select (id_type, id_value) from identifiers)", "id_value not in (select id_value from identifiers where id_type = 'doi')"), P, I, _NEWIDS))
def identifiers_insert_ignore(spark, d):
    """The first writer of an identifier wins."""
    docs = b.read(spark, d, "documents")
    fresh = docs.selectExpr("doc_id as sf_id", "'doi' as id_type", "concat('10.1000/', cast(n_chars % 2000 as string)) as id_value", "'derived' as source", "1.0D as confidence", "doc_id as ordinal")
    return store.add_identifiers(b.identifiers(spark, d), fresh, b.papers(spark, d)).select("sf_id", "id_type", "id_value")


@query(b.sql("select coalesce(p.sf_id, c.sf_id) as sf_id, coalesce(c.title, p.title) as title, coalesce(c.relevance, p.relevance) as relevance, coalesce(p.update_date, c.update_date) as created_at from papers p full join (select sf_id + 500 as sf_id, 'new ' || title as title, 100 - relevance as relevance, update_date from papers) c on c.sf_id = p.sf_id", P))
def upsert_papers(spark, d):
    """Updates replace all but created_at; unknown ids are inserted."""
    p = b.papers(spark, d).select("sf_id", "title", "relevance", F.col("update_date").alias("created_at"))
    return store.upsert_papers(p, p.selectExpr("sf_id + 500 as sf_id", "concat('new ', title) as title", "100 - relevance as relevance", "created_at"))


@query(b.sql("select sf_id, case when relevance > 50 then 'updated' else source end as source, case when relevance > 50 then relevance + 1 else relevance end as relevance from papers", P))
def update_whitelisted(spark, d):
    """Columns off the list are ignored."""
    p = b.papers(spark, d).select("sf_id", "source", "relevance")
    return store.update_papers(p, p.filter("relevance > 50").selectExpr("sf_id", "'updated' as source", "relevance + 1 as relevance", "'x' as title"))


@query(b.sql("select coalesce(p.sf_id, c.sf_id) as sf_id, case when p.sf_id is null then c.title when p.title = '' then c.title else p.title end as title, case when p.sf_id is null then c.venue when p.venue = '' then coalesce(c.venue, '') else p.venue end as venue, greatest(coalesce(p.relevance, 0), coalesce(c.relevance, 0)) as relevance from (select sf_id, title, journal_ref as venue, relevance from papers) p full join (select sf_id + 300 as sf_id, title, 'V. ' || source as venue, n as relevance from (select p.*, (sf_id * 13) % 101 as n from papers p)) c on c.sf_id = p.sf_id", P))
def ensure_paper_merge(spark, d):
    """Blanks are filled, relevance only rises."""
    p = b.papers(spark, d)
    old = p.select("sf_id", "title", F.col("journal_ref").alias("venue"), "relevance")
    return store.ensure_papers(old, p.selectExpr("sf_id + 300 as sf_id", "title", "concat('V. ', source) as venue", "(sf_id * 13) % 101 as relevance"))


@query(b.sql("select event as source, arg_max(status, id) as status, cast(sum(f) as bigint) as total_fetched, cast(sum(n) as bigint) as total_new, max(batch_id) as last_update, coalesce(arg_max(arxiv_id, id) filter (where n > 0), '') as checksum, '' as error from (select *, cast(floor(duration_s) as bigint) as f, cast(id % 3 as bigint) as n from ev) group by event", E))
def state_accumulate(spark, d):
    """Increments add up; the last non-empty checksum stays."""
    e = b.events(spark, d).selectExpr("event as source", "status", "cast(floor(duration_s) as bigint) as fetched", "id % 3 as new", "batch_id as last_update", "case when id % 3 > 0 then arxiv_id else '' end as checksum", "'' as error", "id as ordinal")
    return store.accumulate_state(e)


@query(b.sql("select sf_id, cast(n as integer) as n, title, has_code, substring(abstract, 1, 500) as abstract, ids from (select p.*, coalesce(i.n, 0) as n, coalesce(i.ids, '') as ids from papers p left join (select sf_id, count(*) as n, string_agg(id_type || ':' || id_value, '; ' order by id_type, id_value) as ids from identifiers group by sf_id) i on i.sf_id = p.sf_id)", P, I))
def export_json_nested(spark, d):
    """The rows of the JSON export, with the nested identifiers told as text."""
    e = store.export_rows(b.papers(spark, d), b.identifiers(spark, d))
    return e.select("sf_id", F.size("identifiers").alias("n"), "title", "has_code", "abstract", F.concat_ws("; ", F.transform("identifiers", lambda x: F.concat_ws(":", x["type"], x["value"]))).alias("ids"))


@query(b.sql("select sf_id, cast(has_code as integer) as has_code, coalesce(ids, '') as identifiers from papers p left join (select sf_id as s, string_agg(id_type || ':' || id_value, '; ' order by id_type, id_value) as ids from identifiers group by sf_id) i on i.s = p.sf_id", P, I))
def export_csv_ids(spark, d):
    return store.export_csv_rows(b.papers(spark, d).select("sf_id", "has_code", "abstract"), b.identifiers(spark, d)).select("sf_id", "has_code", "identifiers")


_SF = "((cast(1728000000000 + sf_id * 977 as bigint) - 1728000000000) << 12) + ((sf_id % 64) << 6) + 5 + sf_id % 59"


@query(b.sql(f"select sf_id, {_SF} as id, 1728000000000 + sf_id * 977 as ms, sf_id % 64 as worker, 5 + sf_id % 59 as seq from papers", P))
def snowflake_roundtrip(spark, d):
    p = b.papers(spark, d).select("sf_id", tx.snowflake(F.lit(1728000000000) + F.col("sf_id") * 977, F.col("sf_id") % 64, 5 + F.col("sf_id") % 59).alias("id"))
    return p.select("sf_id", "id", tx.snowflake_ms(F.col("id")).alias("ms"), tx.snowflake_worker(F.col("id")).alias("worker"), tx.snowflake_sequence(F.col("id")).alias("seq"))


_KEY = "lower(regexp_replace(string_split(trim(string_split(authors, ',')[1]), ' ')[-1], '[^a-zA-Z0-9]', '', 'g'))"


@query(b.sql(f"select sf_id, '@article{{' || {_KEY} || cast(year as varchar) || ', title={{' || trim(regexp_replace(title, '[{{}}\n]', ' ', 'g')) || '}}, author={{' || replace(authors, ', ', ' and ') || '}}, year={{' || cast(year as varchar) || '}}, eprint={{' || arxiv_id || '}}' || case when doi = '' then '' else ', doi={{' || doi || '}}' end || '}}' as bibtex, authors || ' (' || cast(year as varchar) || '). ' || title || '. arXiv:' || arxiv_id as reference from meta", P, I, M))
def bibtex_render(spark, d):
    c = F.col
    return b.with_doi(spark, d).select("sf_id", tx.bibtex(c("arxiv_id"), c("title"), c("authors"), c("year"), c("doi")).alias("bibtex"), tx.reference_line(c("arxiv_id"), c("title"), c("authors"), c("year")).alias("reference"))


_PLAIN = r"regexp_replace(lower(trim(title)), '[^a-z0-9\s]', '', 'g')"
_SIM = "len(list_intersect(t, u)) / cast(len(t) + len(u) - len(list_intersect(t, u)) as double)"


@query(b.sql(f"select sf_id, arxiv_id, case when db is null then 'not_in_db' when len(t) > 0 and len(u) > 0 and {_SIM} > 0.5 then 'ok' else 'mismatch' end as status from (select *, {_TRI} as t, {_TRI.replace('plain', 'other')} as u from (select sf_id, arxiv_id, db, {_PLAIN} as plain, {_PLAIN.replace('title', 'db')} as other from (select p.sf_id, p.arxiv_id, case p.sf_id % 3 when 0 then p.title when 1 then substring(p.title, 1, 60) || ' and further words' else o.title end as title, i.title as db from papers p join papers o on o.sf_id = p.sf_id // 2 left join (select arxiv_id, title from papers where lang <> 'fr') i on i.arxiv_id = p.arxiv_id)))", P))
def entity_map_verify(spark, d):
    """Claimed titles are a paper's own, its beginning with other words, or another paper's; French papers aren't known."""
    full = b.papers(spark, d)
    other = full.select(F.col("sf_id").alias("other_id"), F.col("title").alias("other"))
    title = F.when(F.col("sf_id") % 3 == 0, F.col("title")).when(F.col("sf_id") % 3 == 1, F.concat(F.substring("title", 1, 60), F.lit(" and further words"))).otherwise(F.col("other"))
    claimed = full.withColumn("other_id", F.expr("sf_id div 2")).join(other, "other_id").select(F.col("sf_id").alias("entity"), "arxiv_id", title.alias("title"))
    return matching.verify_entities(claimed, full.filter("lang <> 'fr'")).select(F.col("entity").alias("sf_id"), "arxiv_id", "status")


# ---- deduplication ---------------------------------------------------------------------------------------------------


@query(b.sql("select arxiv_id, arg_min(title, priority * 1000000000000 + ordinal) as title, min(priority) as priority from results group by arxiv_id", P, I, M, R))
def multi_source_dedup(spark, d):
    """The first source to give a paper wins."""
    return dedup.session_dedup(b.results(spark, d)).select("arxiv_id", "title", "priority")


@query(b.sql("select distinct arxiv_id from results where arxiv_id not in (select arxiv_id from meta where lang = 'en') and arxiv_id not in (select arxiv_id from meta where doi <> '')", P, I, M, R))
def known_id_anti_join(spark, d):
    m = b.with_doi(spark, d)
    return dedup.exclude_known(dedup.session_dedup(b.results(spark, d)), m.filter("lang = 'en'"), m.filter("doi <> ''")).select("arxiv_id")


@query(b.sql("select arxiv_id, case when lang = 'en' then 'arxiv_meta=' || arxiv_id when doi <> '' then 'paper_store=' || arxiv_id else '' end as reason from meta", P, I, M))
def known_id_reason(spark, d):
    m = b.with_doi(spark, d)
    return dedup.known_reason(m.select("arxiv_id"), m.filter("lang = 'en'"), m.filter("doi <> ''"))


@query(b.sql("select sf_id, md5(abstract) as md5, min(sf_id) over (partition by abstract) as first_id, count(*) over (partition by abstract) as n_copies from papers", P))
def content_hash_dedup(spark, d):
    return dedup.content_groups(b.papers(spark, d), "sf_id", "abstract")


_SIM = "len(list_intersect(t, u)) / cast(len(t) + len(u) - len(list_intersect(t, u)) as double)"


@query(b.sql(f"select sf_id, title from (select sf_id, substring(title, 1, 200) as title, {_TRI} as t, {_TRI.replace('plain', 'other')} as u from (select sf_id, title, {_PLAIN} as plain, {_PLAIN.replace('title', 'ot')} as other from (select p.sf_id, p.title, o.title as ot from papers p join papers o on o.sf_id = p.sf_id // 2))) where not (title <> '') or (len(t) > 0 and len(u) > 0 and {_SIM} >= 0.40)", P))
def title_verify_filter(spark, d):
    """Results that claim an identifier whose indexed title must resemble theirs."""
    p = b.papers(spark, d)
    index = p.selectExpr("cast(sf_id as string) as arxiv_id", "title")
    claims = p.selectExpr("cast(sf_id div 2 as string) as arxiv_id", "title", "sf_id")
    passed = dedup.verified_titles(claims, index).select("sf_id")
    return passed.join(p.select("sf_id", tx.clip(F.col("title"), 200).alias("title")), "sf_id")


# ---- queues and events -----------------------------------------------------------------------------------------------

_PULL = "select q.sf_id, a.id_value as arxiv_id, q.relevance, case when regexp_matches(a.id_value, '^[0-9][0-9]') then 2000 + cast(substring(a.id_value, 1, 2) as integer) else 0 end as arxiv_year, case when d.sf_id is null then null else 1 end as has_doi from q join qids a on a.sf_id = q.sf_id and a.id_type = 'arxiv' left join (select distinct sf_id from qids where id_type = 'doi') d on d.sf_id = q.sf_id where q.download_status = 'pending' and {}"


def _pull(spark, d, tier):
    papers, ids = b.queue(spark, d)
    return queueing.pull(papers, ids, tier).select("sf_id", "arxiv_id", "relevance", "arxiv_year", "has_doi")


@query(b.sql(_PULL.format("q.relevance >= 60"), Q))
def queue_p0(spark, d):
    return _pull(spark, d, "P0")


@query(b.sql(_PULL.format("q.relevance between 30 and 59"), Q))
def queue_p1(spark, d):
    return _pull(spark, d, "P1")


@query(b.sql(_PULL.format("true"), Q))
def queue_p2(spark, d):
    """Whatever is pending."""
    return _pull(spark, d, "P2")


@query(b.sql("select s.status, count(q.sf_id) as n from (select unnest(['pending', 'downloading', 'done', 'failed']) as status) s left join q on q.download_status = s.status group by s.status", Q))
def queue_status_counts(spark, d):
    return queueing.status_counts(b.queue(spark, d)[0])


@query(b.sql("select arxiv_id, arg_max(status, id) as status from ev group by arxiv_id", "ev as (select cast(user_id as varchar) as arxiv_id, case when event_type = 'error' then 'failed' else 'done' end as status, epoch_us(ts) * 1000000::hugeint + event_id as id from events)"))
def status_from_events(spark, d):
    return queueing.status_from_events(b.events(spark, d))


@query(b.sql("select event, count(*) as n, count(*) filter (where status = 'failed') as failures from ev group by event", E))
def event_stats(spark, d):
    return audit.event_stats(b.events(spark, d))


@query(b.sql("select id, arxiv_id, event from ev where event = 'purchase' and arxiv_id = '7' order by id desc limit 50", E))
def event_query_filtered(spark, d):
    return audit.query_events(b.events(spark, d), arxiv_id="7", event="purchase").select("id", "arxiv_id", "event")


@query(b.sql("select batch_id, event, status, count(*) as n from ev group by all", E))
def batch_summary(spark, d):
    return audit.batch_summary(b.events(spark, d))


@query(b.sql("select arg_max(batch_id, id) as batch_id from ev", E))
def latest_batch(spark, d):
    return audit.latest_batch(b.events(spark, d))


@query(b.sql("select batch_id, count(*) filter (where event = 'click' and status = 'done') as downloaded, count(*) filter (where event = 'view' and status = 'done') as converted, count(*) filter (where status = 'failed') as failed, 0::bigint as skipped, 0::bigint as wiki from ev group by batch_id", E))
def batch_counters(spark, d):
    e = b.events(spark, d).withColumn("event", F.when(F.col("event") == "click", "download").when(F.col("event") == "view", "convert").otherwise(F.col("event")))
    return queueing.batch_counters(e)


@query(b.sql("select event, cast(sum(cast(json_extract_string(meta, '$.k') as bigint)) as bigint) as k, count(*) as n from ev group by event", E))
def event_json_meta(spark, d):
    return b.events(spark, d).groupBy("event").agg(F.sum(F.get_json_object("meta", "$.k").cast("bigint")).alias("k"), F.count(F.lit(1)).alias("n"))


@query(b.sql("select q.sf_id, case when l.sf_id is null then q.download_status else 'failed' end as download_status, case when l.sf_id is null then '' else substring(l.reason, 1, 500) end as failed_reason from q left join (select l_orderkey as sf_id, repeat('late ', 150) as reason from lineitem group by l_orderkey having max(l_discount) > 0.09) l on l.sf_id = q.sf_id", Q))
def mark_status(spark, d):
    """Papers whose lines say so fail, with a clipped reason."""
    papers = b.queue(spark, d)[0].withColumn("failed_reason", F.lit(""))
    late = b.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sf_id")).agg(F.max("l_discount").alias("m")).filter("m > 0.09")
    return queueing.mark(papers, late.select("sf_id", F.lit("failed").alias("status"), F.repeat(F.lit("late "), 150).alias("reason"))).select("sf_id", "download_status", "failed_reason")


@query(b.sql("select q.sf_id, case when q.download_status = 'pending' and a.id_value in (select id_value from qids where id_type = 'arxiv' and sf_id in (select l_orderkey from lineitem where l_tax > 0.07)) then 'done' else q.download_status end as download_status from q join qids a on a.sf_id = q.sf_id and a.id_type = 'arxiv'", Q))
def backfill_done(spark, d):
    """Pending papers whose file is there are done."""
    papers, ids = b.queue(spark, d)
    taxed = b.read(spark, d, "lineitem").filter("l_tax > 0.07").select(F.col("l_orderkey").alias("sf_id")).distinct()
    stems = ids.filter("id_type = 'arxiv'").join(taxed, "sf_id", "left_semi").select(F.col("id_value").alias("arxiv_id")).distinct()
    return queueing.backfill_done(papers, ids, stems).select("sf_id", "download_status")


@query(b.sql("select c.name as source, n.n_name as query, cast(n.n_regionkey as integer) as priority from nation n cross join (select r_name as name from region where r_name <> 'ASIA') c"))
def plan_tasks(spark, d):
    """Every enabled source for every query."""
    queries = b.read(spark, d, "nation").selectExpr("n_name as query", "n_regionkey as priority")
    sources = b.read(spark, d, "region").selectExpr("r_name as source", "r_name <> 'ASIA' as enabled")
    return queueing.plan_tasks(queries, sources).select("source", "query", "priority")


@query(b.sql("select case when lang = 'fr' then 'unknown' else lang end as category, count(*) as n from papers group by 1", P))
def results_by_category(spark, d):
    p = b.papers(spark, d)
    return audit.by_category(p.select(F.when(F.col("lang") == "fr", F.array().cast("array<string>")).otherwise(F.split("categories", " ")).alias("categories")))


@query(b.sql("select sf_id, n_in * 0.5::double + n_out * 1.5::double as cost, n_in + n_out <= 6000 and n_in * 0.5 + n_out * 1.5 <= 4000 as fits from (select doc_id as sf_id, n_chars as n_in, n_chars // 4 as n_out from documents)"))
def budget_check(spark, d):
    docs = b.read(spark, d, "documents").selectExpr("doc_id as sf_id", "n_chars as n_in", "n_chars div 4 as n_out")
    i, o = F.col("n_in"), F.col("n_out")
    return docs.select("sf_id", tx.usage_cost(i, o, 0.5, 1.5).alias("cost"), tx.within_budget(i, o, 0.5, 1.5, 6000, 4000.0).alias("fits"))


@query(b.sql(r"select sf_id, regexp_extract(t, '(\d{4}\.\d{4,5})(?:v\d+)?', 1) as arxiv, regexp_extract(t, '10\.\d{4,}/[^\s]+') as doi, case when regexp_matches(arxiv_id, '^[0-9]{2}') then 2000 + cast(substring(arxiv_id, 1, 2) as integer) else 0 end as year from (select sf_id, arxiv_id, abstract || ' https://arxiv.org/abs/' || arxiv_id || 'v4 doi:10.1000/' || cast(sf_id as varchar) || '. end' as t from papers)", P))
def identifier_extract(spark, d):
    """Identifiers at the end of whole texts."""
    t = F.concat("abstract", F.lit(" https://arxiv.org/abs/"), "arxiv_id", F.lit("v4 doi:10.1000/"), F.col("sf_id").cast("string"), F.lit(". end"))
    return b.papers(spark, d).select("sf_id", tx.arxiv_id(t).alias("arxiv"), tx.doi(t).alias("doi"), tx.arxiv_year(F.col("arxiv_id")).alias("year"))


@query(b.sql("select sf_id as ordinal, '10.1000/' || cast(sf_id as varchar) as doi, case when lang = 'en' then arxiv_id else '' end as arxiv_id from papers", P))
def doi_batch_resolve(spark, d):
    """Answers come in chunks of ten, by position; unknown ones are empty."""
    p = b.papers(spark, d)
    answers = p.groupBy(F.floor(F.col("sf_id") / 10).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("sf_id", F.when(F.col("lang") == "en", F.col("arxiv_id")).alias("a")))), lambda x: x["a"]).alias("response"))
    return matching.resolve_batches(p.select(F.col("sf_id").alias("ordinal"), F.concat(F.lit("10.1000/"), F.col("sf_id").cast("string")).alias("doi")), answers)


@query(b.sql("select arxiv_id, case when lang = 'en' then 'a' when doi <> '' then 'b' else 'c' end as code_url from meta", P, I, M))
def code_tiered_match(spark, d):
    """The first tier of level three or more, else the last that was tried."""
    m = b.with_doi(spark, d)
    tier = lambda url, level: m.select("arxiv_id", F.lit(url).alias("code_url"), level.alias("level"))
    return matching.tiered_match([tier("a", F.when(F.col("lang") == "en", 4).otherwise(1)), tier("b", F.when(F.col("doi") != "", 3).otherwise(0)), tier("c", F.lit(2))]).select("arxiv_id", "code_url")


@query(b.sql("select event as source, cast(sum(cast(floor(duration_s) as bigint)) as bigint) as total_fetched, 'failed' as status, 'stopped' as error from ev group by event union all select 'new', 0, 'failed', 'stopped'", E))
def state_set_status(spark, d):
    """A status change keeps the counters."""
    updates = b.events(spark, d).selectExpr("event as source", "status", "cast(floor(duration_s) as bigint) as fetched", "0L as new", "batch_id as last_update", "'' as checksum", "'' as error", "id as ordinal")
    state = store.accumulate_state(updates)
    changes = state.select("source").union(spark.createDataFrame([("new",)], "source string")).withColumns({"status": F.lit("failed"), "error": F.lit("stopped")})
    return store.set_status(state, changes).select("source", "total_fetched", "status", "error")


# ---- confidence, code, pages -----------------------------------------------------------------------------------------


@query(b.sql("select sf_id, case when doi <> '' and journal_ref <> '' then 0.9::double when doi <> '' then 0.6::double else 0.3::double end as metadata, round(least(1.0, 0.3 + case when doi <> '' then 0.3 else 0 end + case when has_code then 0.2 else 0 end + least(relevance / 100.0::double, 0.2)), 6) as europepmc, round(least(1.0, 0.3 + case when doi <> '' then 0.2 else 0 end + 0.2 + case when has_code then 0.2 else 0 end + least(relevance / 200.0::double, 0.1)), 6) as s2 from meta", P, I, M))
def metadata_confidence(spark, d):
    c = F.col
    pdf = F.when(c("has_code"), "Y").otherwise("")
    return b.with_doi(spark, d).select("sf_id", tx.metadata_confidence(c("doi"), c("journal_ref")).alias("metadata"), F.round(tx.confidence_europepmc(c("doi"), pdf, c("relevance")), 6).alias("europepmc"), F.round(tx.confidence_s2(c("doi"), c("arxiv_id"), pdf, c("relevance")), 6).alias("s2"))


@query(b.sql("select arxiv_id, arg_min(code_url, -stars * 1000000 + ordinal) as code_url, max(stars) as stars, cast(case when max(stars) >= 100 then 5 when max(stars) >= 10 then 4 else 3 end as integer) as level from (select cast(page_id as varchar) as arxiv_id, u as code_url, (length(u) * 7) % 130 as stars, i as ordinal from (select page_id, unnest(l) as u, unnest(range(1, len(l) + 1)) as i from (select page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) as l from pages))) group by arxiv_id"))
def code_level_best_repo(spark, d):
    """Every page's links as repositories; stars derive from the address."""
    links = F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1))
    repos = b.read(spark, d, "pages").select(F.col("page_id").cast("string").alias("arxiv_id"), F.posexplode(links).alias("ordinal", "code_url"))
    repos = repos.withColumn("stars", (F.length("code_url") * 7 % 130).cast("bigint"))
    return matching.best_repository(repos).select("arxiv_id", "code_url", "stars", "level")


_LINKED = """linked as (select page_id, case page_id % 5 when 0 then html || '<A class=x HREF="https://github.com/lab' || cast(page_id % 10 as varchar) || '/digit.git"> Code </a><a href="https://github.com/not/this">x</a>'
 when 1 then html || 'see www.github.com/lab' || cast(page_id % 10 as varchar) || '/digit/ for it' when 2 then html || '<a class="my-code" href="https://pages.github.io/lab' || cast(page_id % 10 as varchar) || '/">'
 when 3 then html || '<a class="code" href="https://elsewhere.org/x">' else html end as h from pages)"""
_REPO, _LABELLED, _CLASSED = ("(?i)" + x.replace("'", "''") for x in (tx.REPOSITORY, tx.LABELLED_LINK, tx.CLASSED_LINK))


@query(b.sql(rf"select page_id, case when a <> '' then regexp_replace(regexp_replace(a, '/+$', ''), '\.git$', '') when g <> '' then 'https://github.com/' || regexp_replace(regexp_replace(g, '/+$', ''), '\.git$', '') when contains(lower(c), 'github') then regexp_replace(c, '/+$', '') else '' end as code_url from (select page_id, regexp_extract(h, '{_LABELLED}', 1) as a, regexp_extract(h, '{_REPO}', 1) as g, regexp_extract(h, '{_CLASSED}', 1) as c from linked)", _LINKED))
def code_link_extract(spark, d):
    """Every page with a labelled link, a bare address, a link of a code class to one host or to another, or nothing appended."""
    n = (F.col("page_id") % 10).cast("string")
    more = (
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit('<A class=x HREF="https://github.com/lab'), n, F.lit('/digit.git"> Code </a><a href="https://github.com/not/this">x</a>')))
        .when(F.col("page_id") % 5 == 1, F.concat(F.lit("see www.github.com/lab"), n, F.lit("/digit/ for it"))).when(F.col("page_id") % 5 == 2, F.concat(F.lit('<a class="my-code" href="https://pages.github.io/lab'), n, F.lit('/">')))
        .when(F.col("page_id") % 5 == 3, F.lit('<a class="code" href="https://elsewhere.org/x">')).otherwise("")
    )
    return b.read(spark, d, "pages").select("page_id", tx.github_url(F.concat("html", more)).alias("code_url"))


@query(b.sql(r"select page_id, url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title, trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) as h1, cast(len(list_distinct(regexp_extract_all(html, 'href=" + '"([^"]+)"' + r"', 1))) as integer) as n_links from pages"))
def html_fields(spark, d):
    return readers.html_fields(b.read(spark, d, "pages")).select("page_id", "url", "title", "h1", F.size("links").alias("n_links"))


_CAPITALISED, _TERMS = r"[A-Z][a-z]+(?:[-/][A-Z][a-z]+)*", r"\b(?:PDE|FNO|DeepONet|PINN|GAN|Transformer|CNN|RNN|MLP|ViT|INR|SOTA)\b"


@query(b.sql(f"select p.sf_id, coalesce(k.keywords, '') as keywords from papers p left join (select sf_id, string_agg(w, ',' order by len(w) desc, w) as keywords from (select sf_id, w, row_number() over (partition by sf_id order by min(pos)) as nth from (select sf_id, unnest(l) as w, unnest(range(1, len(l) + 1)) as pos from (select sf_id, list_concat(regexp_extract_all(x, '{_CAPITALISED}'), regexp_extract_all(x, '{_TERMS}')) as l from (select sf_id, title || ' Physics-Informed PINN ' || abstract as x from papers))) where len(w) >= 3 group by sf_id, w) where nth <= 15 group by sf_id) k using (sf_id)", P))
def keyword_extract(spark, d):
    """Of titles and whole abstracts."""
    text = F.concat("title", F.lit(" Physics-Informed PINN "), "abstract")
    return b.papers(spark, d).select("sf_id", F.concat_ws(",", tx.keywords(text)).alias("keywords"))


@query(b.sql("select c.conv_id, count(r.turn) as n, coalesce(string_agg(substring(r.text, 1, 300), '|' order by r.turn), '') as comments from (select distinct conv_id from conversations) c left join conversations r on r.conv_id = c.conv_id and r.role = 'user' group by c.conv_id"))
def review_collect(spark, d):
    """Users' turns as the reviews of their conversation."""
    c = b.read(spark, d, "conversations")
    reviews = c.filter("role = 'user'").select(F.col("conv_id").alias("forum"), F.col("turn").alias("ordinal"), F.lit("").alias("rating"), F.col("text").alias("comment"))
    out = matching.collect_reviews(c.select(F.col("conv_id").alias("forum")).distinct(), reviews)
    return out.select(F.col("forum").alias("conv_id"), F.size("reviews").cast("bigint").alias("n"), F.concat_ws("|", F.transform("reviews", lambda r: r["comment"])).alias("comments"))


# ---- vectors ---------------------------------------------------------------------------------------------------------

_UNIT = "v as (select vec_id, label, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as norm from embeddings)"


_NEAREST = b.sql("select query_id, neighbour_id, sim, cast(rank as integer) as rank from (select q.vec_id as query_id, v.vec_id as neighbour_id, round(list_dot_product(q.e, v.e) / (q.norm * v.norm), 6) as sim, row_number() over (partition by q.vec_id order by round(list_dot_product(q.e, v.e) / (q.norm * v.norm), 6) desc, v.vec_id) as rank from v q join v on v.vec_id <> q.vec_id where q.vec_id % 50 = 0) where rank <= 10", _UNIT)


@query(_NEAREST)
def embedding_cosine_topk(spark, d):
    """Ten nearest of every vector whose id is divisible by 50 (the stated query set), against all."""
    v = b.read(spark, d, "embeddings")
    return matching.nearest(v, v.filter("vec_id % 50 = 0"), 10)


@query(b.sql("select vec_id, arg_min(label, -sim * 10000000000 + label) as label, max(sim) as score from (select v.vec_id, c.label, round(list_dot_product(c.e, v.e) / (c.norm * v.norm), 6) as sim from v join (select * from v where vec_id in (select min(vec_id) from v group by label)) c on true) group by vec_id", _UNIT))
def concept_classify(spark, d):
    """The concept of greatest cosine; a concept is the first vector of a label."""
    v = b.read(spark, d, "embeddings")
    first = v.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    rows = sorted((r["label"], list(r["embedding"])) for r in v.join(F.broadcast(first.limit(matching.MOST_CONCEPTS + 1)), ["label", "vec_id"]).collect())
    names = F.array(*(F.lit(x) for x, _ in rows)) if rows else F.array().cast("array<int>")
    return matching.classify(v, rows).select("vec_id", F.element_at(names, F.col("concept") + 1).alias("label"), "score")


# ---- streams ---------------------------------------------------------------------------------------------------------


def _event_stream(spark, d):
    from pyspark.sql.types import StructType

    schema = b.read(spark, d, "events").schema
    assert isinstance(schema, StructType)
    return spark.readStream.schema(schema).parquet(_folder(spark, f"{d}/events.parquet")).selectExpr("event_id as id", "cast(ts as timestamp) as event_time", "cast(user_id as string) as arxiv_id", "event_type as event", "case when event_type = 'error' then 'failed' else 'done' end as status")


def _folder(spark, path: str) -> str:
    """A stream reads folders: that of a table of parts is itself, a single file is met by a pattern."""
    return path if spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(path)).isDirectory() else path.replace("/events.parquet", "/events.parquet*")


@query(b.sql("select event, status, count(*) as n from ev group by all", E))
def stream_event_counts(spark, d):
    """Counts of a stream, in complete mode."""
    return jobs.to_table(jobs.event_counts(_event_stream(spark, d)), "complete", folder(spark), folder(spark))


@query(b.sql("select distinct arxiv_id, event from ev", E))
def stream_dedup(spark, d):
    """The first event of each paper and kind in a stream; the watermark spans the data."""
    return jobs.to_table(jobs.dedup(_event_stream(spark, d), ["arxiv_id", "event"], "event_time", "3650 days").select("arxiv_id", "event"), "append", folder(spark), folder(spark))


@query(b.sql("select arxiv_id, event, min(id) as id from ev group by all", E))
def stream_into_store(spark, d):
    """Micro-batches into an empty store: the first event of each paper and kind stays."""
    path = folder(spark)
    schema = "arxiv_id string, event string, id bigint"
    spark.createDataFrame([], schema).write.parquet(path)
    stream = _event_stream(spark, d).select("arxiv_id", "event", "id", F.col("id").alias("ordinal"))
    read = lambda: spark.read.schema(schema).parquet(path)
    jobs.into_store(stream, read, lambda fresh: fresh.write.mode("append").parquet(path), ["arxiv_id", "event"], folder(spark)).awaitTermination()
    return read()
