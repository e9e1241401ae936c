"""Registered queries of what grows: pages of cards, ranked search over segments, paging streams, keyed stores, joins of whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import audit, dedup, fts, known, neighbours
from ..operators.buckets import Buckets
from ..operators.segments import Segments
from ..shared import folder
from ..sources import cards, paging, readers
from ..streaming import jobs
from . import bindings as b
from . import readings
from .catalogue import _FIELDS, _NEAREST, _count, _event_stream, _fts_sql, _scored, query

P, I, M, R, E = b.PAPERS, b.IDENTIFIERS, b.META, b.RESULTS, b.EVENTS

# ---- cards of a page -------------------------------------------------------------------------------------------------

_NUMBERED = "numbered as (select page_id, html, cast(page_id as varchar) as n, '2301.' || lpad(cast(page_id % 100000 as varchar), 5, '0') as id, page_id % 4 as kind from pages)"
_UNESCAPED = "regexp_replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;?', '&', 'g')"
_CARDS = f"""select page_id, 0 as card, -1 as parent, substring(trim({_UNESCAPED.format("regexp_extract(html, '<h1>([^<]*)<', 1)")}), 1, 200) as title, id as arxiv_id, '' as code_url,
 substring(trim({_UNESCAPED.format("regexp_extract(html, '<br><p>([^<]*)<', 1)")}), 1, 500) as abstract from numbered where page_id % 3 = 0
 union all select page_id, 1, -1, 'Outer ' || n, id, 'https://github.com/lab/' || n, 'About ' || n || ' & more' from numbered where kind = 0
 union all select page_id, 2, 1, 'Inner ' || n, id, '', 'About ' || n || ' & more' from numbered where kind = 0
 union all select page_id, 1, -1, 'Open ' || n, id, '', 'Left open ' || n from numbered where kind = 1
 union all select page_id, 1, -1, 'Linked ' || n, id, '', '' from numbered where kind = 2"""


def _with_cards(pages):
    """Pages whose own article is a card in every third, with nested, unclosed and hidden cards appended by their number."""
    n, kind = F.col("page_id").cast("string"), F.col("page_id") % 4
    aid = F.concat(F.lit("2301."), F.lpad((F.col("page_id") % 100000).cast("string"), 5, "0"))
    own = F.replace(F.replace("html", F.lit("<h1>"), F.concat(F.lit('<a href="https://arxiv.org/abs/'), aid, F.lit('v2">x</a><h2>'))), F.lit("</h1>"), F.lit("</h2>"))
    nested = F.concat(F.lit('<div class="paper-card"><h3> Outer '), n, F.lit(" </h3><div class='inner card'><h2>Inner "), n, F.lit("</h2><a HREF='https://arxiv.org/pdf/"), aid, F.lit("'>pdf</a><p>About "), n, F.lit(' &amp; more</p></div><a href="https://github.com/lab/'), n, F.lit('">Code</a></div>'))
    left_open = F.concat(F.lit("<div class=card><h2>Open "), n, F.lit("<p>Left open "), n, F.lit("<a href=https://arxiv.org/abs/"), aid, F.lit(">"))
    hidden = F.concat(F.lit('<!-- <div class="card"><h2>no</h2> --><script>"<article><h2>no</h2>"</script><article><a href="/papers/'), n, F.lit('">Linked '), n, F.lit('</a><a href="https://arxiv.org/abs/'), aid, F.lit('v1">x</a></article>'))
    more = F.when(kind == 0, nested).when(kind == 1, left_open).when(kind == 2, hidden).otherwise("")
    return pages.select("page_id", F.concat(F.when(F.col("page_id") % 3 == 0, own).otherwise(F.col("html")), more).alias("html"))


@query(b.sql(_CARDS, _NUMBERED))
def page_cards(spark, d):
    """Every card of every page that has a title and an identifier."""
    found = cards.listed_papers(cards.page_cards(_with_cards(b.read(spark, d, "pages"))))
    return found.select("page_id", "card", "parent", "title", "arxiv_id", "code_url", "abstract")


# ---- citations -------------------------------------------------------------------------------------------------------

_PLAIN_TITLE = r"lower(trim(regexp_replace(regexp_replace(title, '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')))"
_WANTED = f"""plain as (select sf_id, {_PLAIN_TITLE} as t, year, authors, source from papers), wanted as (select sf_id as cite_id, array_to_string(string_split(t, ' ')[1:4], ' ') as w, year + sf_id % 6 as hint, case when sf_id % 2 = 0 then source else 'nobody' end as who from plain where t <> ''),
 scored as (select cite_id, p.sf_id as doc_id, cast(printf('%.2f', least(1.0::double, 0.8::double * (2.0::double * len(w) / (len(w) + len(t))) + case when w = t then 0.15::double else 0 end + case when abs(p.year - hint) <= 1 then 0.2::double when abs(p.year - hint) <= 3 then 0.1::double else 0 end + case when contains(lower(p.authors), lower(who)) then 0.2::double else 0 end)) as double) as score
 from wanted join plain p on contains(' ' || t || ' ', ' ' || w || ' '))"""


@query(b.sql("select cite_id, doc_id, score, case when score >= 0.7 then 'VERIFIED' when score >= 0.4 then 'SUSPECTED' else 'NOT_FOUND' end as status from scored qualify row_number() over (partition by cite_id order by score desc, doc_id) <= 3", P, _WANTED))
def citation_best_three(spark, d):
    """The beginning of every title as a citation, against all titles: the longest common block is then the citation itself, so SQL knows the ratio."""
    p = b.papers(spark, d)
    t = F.array_join(F.slice(audit.title_tokens(F.col("title")), 1, 4), " ")
    cites = p.select(F.col("sf_id").alias("cite_id"), t.alias("title"), F.when(F.col("sf_id") % 2 == 0, F.col("source")).otherwise("nobody").alias("authors_hint"), (F.col("year") + F.col("sf_id") % 6).alias("year_hint")).filter("title <> ''")
    return audit.check_citations(cites, p.select(F.col("sf_id").alias("doc_id"), "title", "abstract", "authors", "update_date"), columns=("title",)).select("cite_id", "doc_id", "score", "status")


@query(b.sql("select cite_id, case when s0 >= s1 then 0 else 1 end as ordinal, greatest(s0, s1) as sim from (select sf_id as cite_id, greatest(0.7::double, 2.0::double * len(t) / (2 * len(t) + 18)) as s0, greatest(0.7::double, 2.0::double * len(w) / (len(t) + len(w))) as s1 from (select sf_id, t, array_to_string(string_split(t, ' ')[1:9], ' ') as w from plain where t <> ''))", P, _WANTED))
def title_ratio_longer_shorter(spark, d):
    """Every title against an answer with further words and one of its first nine words: below 0.7, an answer within or around the title counts as 0.7."""
    wanted = b.papers(spark, d).select(F.col("sf_id").alias("cite_id"), F.concat_ws(" ", audit.title_tokens(F.col("title"))).alias("t")).filter("t <> ''")
    longer = wanted.select("cite_id", F.lit(0).alias("ordinal"), F.concat(F.lit("  "), "t", F.lit(", and further words!")).alias("title"))
    shorter = wanted.select("cite_id", F.lit(1).alias("ordinal"), F.array_join(F.slice(F.split("t", " "), 1, 9), "  ").alias("title"))
    return audit.remote_matches(wanted.withColumnRenamed("t", "title"), longer.unionByName(shorter)).select("cite_id", "ordinal", "sim")


# ---- nearest vectors -------------------------------------------------------------------------------------------------


@query(_NEAREST)
def embedding_pivot_join(spark, d):
    """As embedding_cosine_topk, with cells and bounds in place of a broadcast of the queries."""
    v = b.read(spark, d, "embeddings")
    return neighbours.join(v, v.filter("vec_id % 50 = 0"), 10)


# ---- keyed tables in buckets -----------------------------------------------------------------------------------------


@query(b.sql("select arxiv_id, event, min(id) as id from ev group by all", E))
def stream_into_buckets(spark, d):
    """Micro-batches into a table of which each reads its own buckets: the first event of each paper and kind stays."""
    store = Buckets(spark, folder(spark), "arxiv_id string, event string, id bigint", ["arxiv_id", "event"], 16)
    stream = _event_stream(spark, d).select("arxiv_id", "event", "id", F.col("id").alias("ordinal"))
    jobs.into_buckets(stream, store, folder(spark)).awaitTermination()
    return store.read()


@query(b.sql("select o_orderkey as sf_id, case when l.n is null then o_orderstatus else 'late' end as status, coalesce(l.n, 0) as lines, o_orderdate as created_at from orders left join (select l_orderkey, count(*) as n from lineitem where l_orderkey % 97 < 3 group by l_orderkey) l on l_orderkey = o_orderkey union all select -1 - o_orderkey, 'new', 0, null from orders where o_orderkey % 101 = 0"))
def bucket_upsert(spark, d):
    """Orders in buckets; papers of late lines replace theirs but for the date, others are inserted: two changes, one after the other."""
    store = Buckets(spark, folder(spark), "sf_id bigint, status string, lines bigint, created_at timestamp", ["sf_id"], 16)
    orders = b.read(spark, d, "orders")
    store.upsert(orders.selectExpr("o_orderkey as sf_id", "o_orderstatus as status", "0L as lines", "cast(o_orderdate as timestamp) as created_at"))
    late = b.read(spark, d, "lineitem").filter("l_orderkey % 97 < 3").groupBy(F.col("l_orderkey").alias("sf_id")).agg(F.count(F.lit(1)).alias("lines"))
    store.upsert(late.select("sf_id", F.lit("late").alias("status"), "lines", F.lit(None).cast("timestamp").alias("created_at")), keep=["created_at"])
    store.upsert(orders.filter("o_orderkey % 101 = 0").selectExpr("-1 - o_orderkey as sf_id", "'new' as status", "0L as lines", "cast(null as timestamp) as created_at"))
    return store.read().withColumn("created_at", F.col("created_at").cast(dict(orders.dtypes)["o_orderdate"]))


# ---- an index that grows ---------------------------------------------------------------------------------------------


@query(_fts_sql([_count("x = 'der'"), _count("x = 'ein'"), _count("x = 'that'")], "(tf0 > 0 or tf1 > 0) and not tf2 > 0", "order by raw desc, sf_id limit 10", scored=[0, 1]))
def fts_segments_topk(spark, d):
    """Three batches, the later ones replacing documents of the earlier, and the ten best by bounds of blocks: as of one index of the last state."""
    p = b.papers(spark, d)
    index = Segments(spark, folder(spark), "sf_id", _FIELDS, stemmed=False)
    index.add(p.filter("sf_id % 3 <> 2").withColumn("abstract", F.concat(F.lit("der ein der ein "), F.substring("abstract", 1, 200))))
    index.add(p.filter("sf_id % 3 = 0"))
    index.add(p.filter("sf_id % 3 <> 0"))
    return _scored(index.search("(der OR ein) NOT that").withColumnRenamed("doc", "sf_id"))


# ---- pages of a service ----------------------------------------------------------------------------------------------


@query(readings.sql("select arxiv_id, t as title, a as abstract, update_date from (select arxiv_id, trim(t) as t, trim(substring(a, 1, 400)) as a, update_date from clean) where t <> ''"))
def stream_paged_harvest(spark, d):
    """Pages of a hundred records each, followed by their tokens into a table in buckets: one micro-batch, then a restart from the checkpoint for the rest."""
    c = readings._clean(spark, d).withColumn("page", F.expr("sf_id div 100"))
    element = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    meta = F.concat(element("id", F.col("arxiv_id")), element("title", F.col("t")), element("abstract", F.substring("a", 1, 400)), element("updated", F.col("update_date")))
    record = F.concat(F.lit("<record>"), element("header", element("datestamp", F.col("update_date"))), element("metadata", element("arXiv", meta)), F.lit("</record>"))
    pages = c.groupBy("page").agg(F.concat_ws("", F.collect_list(record)).alias("records"))  # a hundred records at most
    following = pages.select("page").withColumn("token", F.lead("page").over(Window.orderBy("page")))  # a row a page
    told = pages.join(following, "page").select("page", F.concat(F.lit('<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>'), "records", F.coalesce(element("resumptionToken", F.col("token").cast("string")), F.lit("")), F.lit("</ListRecords></OAI-PMH>")).alias("value"))
    root, checkpoint = folder(spark), folder(spark)
    told.write.partitionBy("page").text(root)
    store = Buckets(spark, folder(spark), "arxiv_id string, title string, abstract string, update_date string", ["arxiv_id"], 16)
    start = lambda most, **how: jobs.into_buckets(paging.oai_records(paging.stream(spark, paging.FolderPages(root), most=most, growing=True)).select("arxiv_id", "title", "abstract", "update_date"), store, checkpoint, **how)
    start(3).awaitTermination()
    rest = start(32, every="0 seconds")
    rest.processAllAvailable()
    rest.stop()
    return store.read()


# ---- known ids -------------------------------------------------------------------------------------------------------


@query(b.sql("select distinct arxiv_id from results where arxiv_id not in (select arxiv_id from meta where lang = 'en') and arxiv_id not in (select arxiv_id from meta where doi <> '')", P, I, M, R))
def known_id_filter(spark, d):
    """As known_id_anti_join, by the way for many rows on either side: only what a Bloom filter passes is shuffled."""
    m = b.with_doi(spark, d)
    ids = m.filter("lang = 'en'").select("arxiv_id").unionByName(m.filter("doi <> ''").select("arxiv_id"))
    return known.exclude(dedup.session_dedup(b.results(spark, d)), ids, few=0).select("arxiv_id")


# ---- archives --------------------------------------------------------------------------------------------------------


@query("select doc_id, md5(text) as md5 from documents where text is not null")
def archive_unpack(spark, d):
    """Archives of two hundred documents each, written by tasks; their members are listed and unpacked, a task each."""
    root = folder(spark)

    def zipped(batch):
        import io
        import json
        import zipfile

        from pyarrow import fs

        made, number = io.BytesIO(), int(batch["number"].iloc[0])
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
            for part in (0, 1):
                z.writestr(f"deep/part{part}.jsonl", "".join(json.dumps({"doc_id": int(i), "text": t}) + "\n" for i, t in zip(batch["doc_id"], batch["text"], strict=True) if i % 2 == part))
            z.writestr("notes.txt", "none")
        store, at = fs.FileSystem.from_uri(root if "://" in root else f"file://{root.removeprefix('file:')}")
        store.create_dir(at)
        with store.open_output_stream(f"{at}/{number}.zip") as out:
            out.write(made.getvalue())
        return batch[["number"]][:1]

    docs = b.read(spark, d, "documents").filter("text is not null").select("doc_id", "text", F.expr("doc_id div 200").alias("number"))
    docs.groupBy("number").applyInPandas(zipped, "number bigint").count()
    members = readers.archive_members(spark, root).filter("member like '%.jsonl'")
    lines = readers.member_lines(members).select(F.from_json("value", "doc_id bigint, text string").alias("r"))
    return lines.select("r.doc_id", F.md5(F.col("r.text").cast("binary")).alias("md5"))


# ---- columns of a search, chains of items, reports -------------------------------------------------------------------


@query(_fts_sql(["len(list_filter(t0, lambda x: x = 'der'))", "len(list_filter(t1, lambda x: x = 'src1'))", _count("x = 'that'")], "(tf0 > 0 or tf1 > 0) and not tf2 > 0", "", scored=[0, 1]))
def fts_column_filter(spark, d):
    """A term in titles or one in authors, in documents without a third in any column."""
    index = fts.Index.build(b.papers(spark, d), "sf_id", _FIELDS, stemmed=False)
    return index.match("(title:der OR authors:src1) NOT that").select(F.col("doc").alias("sf_id"), F.round("score", 6).alias("score"))


#: All words that these two stems stand for; the tests hold them against the stemmer.
STEM_FORMS = {"the": "^the(s|ing|ings)?$", "in": "^in(e|s|es|ed|eds|ing|ings|ness)?$"}


@query(_fts_sql([_count(f"regexp_matches(x, '{STEM_FORMS['the']}')"), _count(f"regexp_matches(x, '{STEM_FORMS['in']}')")], "tf0 > 0 and tf1 > 0", ""))
def fts_stem_forms(spark, d):
    """Two words that occur in other forms too, by their stems."""
    index = fts.Index.build(b.papers(spark, d), "sf_id", _FIELDS, stemmed=True)
    return index.match("thes AND ining").select(F.col("doc").alias("sf_id"), F.round("score", 6).alias("score"))


_CHAINED = "select arxiv_id, substring(title, 1, 20) as title, relevance, case when relevance >= 60 then 'P0' else 'P1' end as tier from papers where relevance >= 30 and regexp_matches(arxiv_id, '^[0-9]{4}[.][0-9]{4,5}$')"


@query(b.sql(_CHAINED, P))
def stream_item_chain(spark, d):
    """One chain of steps (valid identifiers, relevant ones, clipped titles, tiers) over a stream of written papers."""
    steps = jobs.chain(
        lambda df: df.filter(tx.is_arxiv_id(F.col("arxiv_id"))), lambda df: df.filter("relevance >= 30"), lambda df: df.withColumn("title", tx.clip(F.col("title"), 20)),
        lambda df: df.withColumn("tier", F.when(F.col("relevance") >= 60, "P0").otherwise("P1")),
    )
    root = folder(spark)
    papers = b.papers(spark, d).select("arxiv_id", "title", "relevance")
    papers.write.parquet(root)
    return jobs.to_table(steps(jobs.pages(spark, root, papers._jdf.schema().toDDL(), "parquet", 2)), "append", folder(spark), folder(spark))


@query(b.sql("select string_agg(line, chr(10) order by o) as report from (select 0 as o, 'Citation audit' || chr(10) || '==============' || chr(10) || 'citations: ' || cast(count(*) as varchar) as line from papers union all select o, printf('%-10s %8d  %5.1f %%', s, count(*), 100.0::double * count(*) / (select count(*) from papers)) from (select case when relevance >= 70 then 1 when relevance >= 40 then 2 else 3 end as o, case when relevance >= 70 then 'VERIFIED' when relevance >= 40 then 'SUSPECTED' else 'NOT_FOUND' end as s from papers) group by o, s)", P))
def report_text(spark, d):
    """The text of an audit over all papers, whose statuses are made of their relevance."""
    results = b.papers(spark, d).select(tx.status_of(F.col("relevance") / 100).alias("status"))
    totals = {r["status"]: r["n"] for r in audit.report_totals(results).collect()}  # a row a status
    return spark.createDataFrame([(audit.render_report(totals),)], "report string")
