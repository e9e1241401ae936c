"""Readers: payloads of bibliographic services to rows. Schemas are explicit, since inference turns identifiers into numbers.

Readers of files take paths; readers of payloads take a DataFrame with a string column, so they work on files, streams
and tables alike. Rows carry an ordinal where the first one must win later.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx

RAW_META = """id string, title string, authors string, abstract string, categories string, doi string, `journal-ref` string, journal_ref string,
 update_date string, _corrupt_record string"""


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _joined(c: str, sep: str) -> Column:
    """A string field, or the items of one that came as a JSON array."""
    x = _text(c)
    return F.when(x.startswith("["), F.concat_ws(sep, F.from_json(x, "array<string>"))).otherwise(x)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Metadata dumps, a JSON object a line: blank and broken lines and rows without id go, text is clipped, the first id wins later."""
    raw = spark.read.schema(RAW_META).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    good = raw.filter(F.col("_corrupt_record").isNull() & (_text("id") != ""))
    return good.select(
        F.monotonically_increasing_id().alias("ordinal"), F.col("id").alias("arxiv_id"), tx.clip(_text("title"), 500).alias("title"), tx.clip(_joined("authors", ", "), 500).alias("authors"),
        tx.clip(_text("abstract"), 2000).alias("abstract"), _joined("categories", " ").alias("categories"), _text("doi").alias("doi"),
        tx.clip(F.coalesce("journal_ref", "`journal-ref`", F.lit("")), 200).alias("journal_ref"), _text("update_date").alias("update_date"),
    )


def kaggle_lines(spark: SparkSession, path: str) -> DataFrame:
    """The Kaggle dump: identifiers lose their version and archive, lists become text, nothing is clipped."""
    raw = spark.read.schema(RAW_META).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    good = raw.filter(F.col("_corrupt_record").isNull() & (_text("id") != ""))
    return good.select(
        F.monotonically_increasing_id().alias("ordinal"), tx.bare_id(F.col("id")).alias("arxiv_id"), _text("title").alias("title"), _joined("authors", ", ").alias("authors"),
        _text("abstract").alias("abstract"), _joined("categories", " ").alias("categories"), _text("doi").alias("doi"),
        F.coalesce("`journal-ref`", "journal_ref", F.lit("")).alias("journal_ref"), _text("update_date").alias("update_date"), F.lit("kaggle").alias("source"),
    )


OAI_RECORD = """header struct<_status: string, identifier: string, status: string>,
 metadata struct<arXiv: struct<id: string, title: string, authors: string, abstract: string, categories: string, doi: string, `journal-ref`: string,
 version: struct<date: string>, created: string, updated: string>>"""


def oai_records(spark: SparkSession, path: str) -> DataFrame:
    """Pages of OAI-PMH records. Deleted ones, old-style identifiers and records without title go; all text is clipped to 500."""
    return oai_rows(spark.read.format("xml").option("rowTag", "record").option("ignoreNamespace", True).schema(OAI_RECORD).load(path))


def oai_rows(raw: DataFrame) -> DataFrame:
    """Records as parsed (header, metadata) to rows of metadata."""
    m = "metadata.arXiv"
    el = lambda c: tx.clip(F.trim(_text(f"{m}.{c}")), 500)
    rows = raw.filter(F.col("metadata").isNotNull() & (F.coalesce("header._status", "header.status", F.lit("")) != "deleted"))
    return rows.select(
        el("id").alias("arxiv_id"), el("title").alias("title"), el("authors").alias("authors"), el("abstract").alias("abstract"), el("categories").alias("categories"), el("doi").alias("doi"),
        tx.clip(el("`journal-ref`"), 200).alias("journal_ref"), F.substring(F.coalesce(f"{m}.version.date", f"{m}.updated", f"{m}.created", F.lit("")), 1, 10).alias("update_date"), F.lit("oai").alias("source"),
    ).filter(tx.is_arxiv_id(F.col("arxiv_id")) & (F.col("title") != ""))


ATOM_ENTRY = "id string, title string, summary string, published string, author array<struct<name: string>>, category array<struct<_term: string>>"


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an Atom feed with an arXiv identifier."""
    raw = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", True).schema(ATOM_ENTRY).load(path)
    return raw.select(
        tx.arxiv_id(_text("id")).alias("arxiv_id"), tx.clip(F.trim(F.regexp_replace(_text("title"), r"\s+", " ")), 200).alias("title"), tx.clip(F.trim(_text("summary")), 500).alias("abstract"),
        F.concat_ws(", ", F.transform("author", lambda a: a["name"])).alias("authors"), F.transform("category", lambda c: c["_term"]).alias("categories"), F.substring("published", 1, 10).alias("published"),
    ).filter("arxiv_id <> ''")


def daily_papers(payloads: DataFrame, column: str = "json") -> DataFrame:
    """JSON arrays of {id, title, summary}; rows whose id begins as an arXiv identifier."""
    each = payloads.select(F.explode(F.from_json(column, "array<struct<id: string, title: string, summary: string>>")).alias("p"))
    return each.select(F.regexp_extract(_text("p.id"), "^" + tx.ARXIV_ID, 1).alias("arxiv_id"), _text("p.title").alias("title"), _text("p.summary").alias("abstract"), F.lit("hf").alias("source")).filter("arxiv_id <> ''")


def openreview_notes(payloads: DataFrame, column: str = "json") -> DataFrame:
    """{"notes": [...]} with plain or wrapped fields. The arXiv id stands under one of four keys, else anywhere in the content."""
    notes = payloads.select(F.explode(F.from_json(F.get_json_object(column, "$.notes"), "array<string>")).alias("n"))
    content = F.get_json_object("n", "$.content")
    field = lambda k: tx.nested_text(content, k)
    keyed = [F.nullif(tx.arxiv_id(field(k)), F.lit("")) for k in ("arxiv_id", "arxiv", "paper_link", "html")]
    bib = F.nullif(F.regexp_extract(field("_bibtex"), r"eprint\s*=\s*\{(" + tx.ARXIV_ID[1:-len("(?:v\\d+)?") - 1] + ")", 1), F.lit(""))
    return notes.select(
        F.get_json_object("n", "$.forum").alias("forum"), F.coalesce(*keyed, bib, tx.arxiv_id(content), F.lit("")).alias("arxiv_id"), tx.clip(field("title"), 200).alias("title"),
        tx.clip(field("abstract"), 500).alias("abstract"), F.substring_index(field("venueid"), "/", 1).alias("venue"), field("pdf").alias("pdf"), F.lit("openreview").alias("source"),
    )


def openreview_reviews(payloads: DataFrame, column: str = "json") -> DataFrame:
    """Notes whose invitation names a review: forum, ordinal, rating (or recommendation), comment clipped to 300."""
    notes = payloads.select(F.posexplode(F.from_json(F.get_json_object(column, "$.notes"), "array<string>")).alias("ordinal", "n"))
    content = F.get_json_object("n", "$.content")
    rating = F.coalesce(F.nullif(tx.nested_text(content, "rating"), F.lit("")), tx.nested_text(content, "recommendation"))
    comment = F.coalesce(F.nullif(tx.nested_text(content, "review"), F.lit("")), tx.nested_text(content, "comment"))
    return notes.filter(F.coalesce(F.get_json_object("n", "$.invitation"), F.get_json_object("n", "$.invitations"), F.lit("")).contains("Review")).select(F.get_json_object("n", "$.forum").alias("forum"), "ordinal", rating.alias("rating"), tx.clip(comment, 300).alias("comment"))


PWC = "array<struct<arxiv_id: string, url_abs: string, title: string, abstract: string, repositories: array<struct<url: string, stars: bigint, is_official: boolean>>>>"


def papers_with_code(payloads: DataFrame, column: str = "json") -> DataFrame:
    """{"results": [...]}; the repository is the first official one, else the first with an address."""
    p = payloads.select(F.explode(F.from_json(F.get_json_object(column, "$.results"), PWC)).alias("p")).select("p.*")
    with_url = F.filter("repositories", lambda r: F.coalesce(r["url"], F.lit("")) != "")
    repo = F.coalesce(F.try_element_at(F.filter(with_url, lambda r: F.coalesce(r["is_official"], F.lit(False))), F.lit(1)), F.try_element_at(with_url, F.lit(1)))
    aid = F.coalesce(F.nullif(_text("arxiv_id"), F.lit("")), tx.arxiv_id(_text("url_abs")))
    return p.select(aid.alias("arxiv_id"), tx.clip(_text("title"), 200).alias("title"), tx.clip(_text("abstract"), 500).alias("abstract"), _text(repo["url"]).alias("code_url"), F.coalesce(repo["stars"], F.lit(0)).alias("stars")).filter("arxiv_id <> ''")


EPMC = "array<struct<id: string, source: string, title: string, authorString: string, journalTitle: string, pubYear: string, doi: string, abstractText: string, hasPDF: string, citedByCount: int>>"


def europe_pmc(payloads: DataFrame, column: str = "json") -> DataFrame:
    r = payloads.select(F.posexplode(F.from_json(F.get_json_object(column, "$.resultList.result"), EPMC)).alias("ordinal", "r")).select("ordinal", "r.*").filter(_text("title") != "")
    return r.select(
        "ordinal", tx.clip(_text("title"), 200).alias("title"), tx.clip(_text("abstractText"), 500).alias("abstract"), _text("authorString").alias("authors"), _text("doi").alias("doi"),
        tx.venue_year(F.col("journalTitle"), F.col("pubYear")).alias("venue"), tx.confidence_europepmc(_text("doi"), _text("hasPDF"), F.coalesce("citedByCount", F.lit(0))).alias("confidence"), F.lit("europepmc").alias("source"),
    )


S2 = """array<struct<paperId: string, title: string, abstract: string, year: int, externalIds: struct<DOI: string, ArXiv: string>, openAccessPdf: struct<url: string>,
 journal: struct<name: string>, venue: string, authors: array<struct<name: string>>, citationCount: int>>"""


def semantic_scholar(payloads: DataFrame, column: str = "json") -> DataFrame:
    r = payloads.select(F.posexplode(F.from_json(F.get_json_object(column, "$.data"), S2)).alias("ordinal", "r")).select("ordinal", "r.*")
    doi, aid, pdf = _text("externalIds.DOI"), _text("externalIds.ArXiv"), _text("openAccessPdf.url")
    return r.select(
        "ordinal", aid.alias("arxiv_id"), doi.alias("doi"), tx.clip(_text("title"), 200).alias("title"), tx.clip(_text("abstract"), 500).alias("abstract"),
        F.concat_ws(", ", F.transform(F.slice(F.coalesce("authors", F.array().cast("array<struct<name:string>>")), 1, 5), lambda a: a["name"])).alias("authors"),
        tx.venue_year(F.coalesce("journal.name", "venue"), F.col("year")).alias("venue"), tx.confidence_s2(doi, aid, pdf, F.coalesce("citationCount", F.lit(0))).alias("confidence"), F.lit("semanticscholar").alias("source"),
    )


def semantic_scholar_batch(payloads: DataFrame, column: str = "json") -> DataFrame:
    """chunk, response: the arXiv ids of a batch answer, null where the service knew nothing."""
    return payloads.select("chunk", F.transform(F.from_json(column, "array<struct<paperId: string, externalIds: struct<DOI: string, ArXiv: string>>>"), lambda p: p["externalIds"]["ArXiv"]).alias("response"))


_DATE = "struct<`date-parts`: array<array<int>>>"
CROSSREF = f"""struct<DOI: string, title: array<string>, `container-title`: array<string>, `published-print`: {_DATE}, `published-online`: {_DATE}, issued: {_DATE},
 created: {_DATE}, relation: string, abstract: string>"""


def crossref_works(payloads: DataFrame, column: str = "json") -> DataFrame:
    """{"message": {"items": [...]}} or {"message": {...}}: title, venue, the first year there is, and an arXiv id from relations or text."""
    items = F.coalesce(F.get_json_object(column, "$.message.items"), F.concat(F.lit("["), F.get_json_object(column, "$.message"), F.lit("]")))
    raw = payloads.select(F.posexplode(F.from_json(items, "array<string>")).alias("ordinal", "raw")).select("ordinal", "raw", F.from_json("raw", CROSSREF).alias("w"))
    year = F.coalesce(*(F.try_element_at(F.try_element_at(F.col(f"w.`{k}`.`date-parts`"), F.lit(1)), F.lit(1)) for k in ("published-print", "published-online", "issued", "created")), F.lit(0))
    first = lambda k: _text(F.try_element_at(F.col(f"w.`{k}`"), F.lit(1)))
    aid = F.coalesce(F.nullif(tx.arxiv_id(_text("w.relation")), F.lit("")), tx.arxiv_id(F.col("raw")))
    return raw.select("ordinal", _text("w.DOI").alias("doi"), first("title").alias("title"), first("container-title").alias("venue"), year.alias("year"), aid.alias("arxiv_id"))


OPENALEX = "array<struct<id: string, title: string, publication_year: int, doi: string, primary_location: struct<source: struct<display_name: string>>, authorships: array<struct<author: struct<display_name: string>>>>>"


def openalex_works(payloads: DataFrame, column: str = "json") -> DataFrame:
    r = payloads.select(F.posexplode(F.from_json(F.get_json_object(column, "$.results"), OPENALEX)).alias("ordinal", "r")).select("ordinal", "r.*")
    return r.select("ordinal", _text("title").alias("title"), F.coalesce("publication_year", F.lit(0)).alias("year"), F.regexp_replace(_text("doi"), "^https?://doi.org/", "").alias("doi"), _text("primary_location.source.display_name").alias("venue"), F.concat_ws(", ", F.transform("authorships", lambda a: a["author"]["display_name"])).alias("authors"))


GITHUB = "array<struct<full_name: string, name: string, description: string, html_url: string, stargazers_count: bigint, owner: struct<login: string>>>"


def github_repositories(payloads: DataFrame, column: str = "json") -> DataFrame:
    """Carries the other columns (such as arxiv_id) of the payload along."""
    keep = [c for c in payloads.columns if c != column]
    r = payloads.select(*keep, F.posexplode(F.from_json(F.get_json_object(column, "$.items"), GITHUB)).alias("ordinal", "r"))
    return r.select(*keep, "ordinal", _text("r.name").alias("name"), _text("r.description").alias("description"), _text("r.owner.login").alias("owner"), _text("r.html_url").alias("code_url"), F.coalesce("r.stargazers_count", F.lit(0)).alias("stars"))


def html_fields(pages: DataFrame, column: str = "html") -> DataFrame:
    """Title, first heading, links, code link and next-page link of pages."""
    get = lambda p: F.trim(F.regexp_extract(column, p, 1))
    return pages.withColumns({"title": get(r"(?is)<title[^>]*>(.*?)</title>"), "h1": get(r"(?is)<h1[^>]*>(.*?)</h1>"), "links": tx.links(F.col(column)), "code_url": tx.github_url(F.col(column)), "next_page": get(r'(?i)<a[^>]*rel="next"[^>]*href="([^"]+)"')})


def _store(path: str):
    """The store of a path and the path there; None of a store that tasks can't list themselves."""
    import pyarrow as pa
    from pyarrow import fs

    if "://" not in path or path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file://").removeprefix("file:"))
    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, NotImplementedError):
        return None


def _shown(name: str) -> bool:
    """Whether Spark's readers would take a file or folder of that name."""
    return not name.startswith(".") and (not name.startswith("_") or "=" in name)


def files_below(spark: SparkSession, path: str, suffix: str = "", recursive: bool = True) -> DataFrame:
    """path, length of the files in a folder, hidden and empty ones left out; recursive: also in those below.

    The driver lists nothing: one task lists the folder, and the folders in it are dealt to tasks, which list all below. So files
    of any number that lie in folders of bounded size burden no process. Patterns, and stores that only Spark's readers
    reach, are listed by these.
    """
    if any(c in path for c in "*?[{") or _store(path) is None:
        return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", f"*{suffix}").load(path).select("path", "length")
    store, top = _store(path)
    base = "file:" if "://" not in path or path.startswith("file:") else path.rstrip("/").removesuffix(top.rstrip("/"))

    def told(found, under: str):
        import pandas as pd

        rows = [(f.path, f.size if f.is_file else -1) for f in found if all(map(_shown, f.path[len(under) :].strip("/").split("/")))]
        for i in range(0, len(rows), 10_000):
            yield pd.DataFrame(rows[i : i + 10_000], columns=["path", "length"])

    def first(batches):
        from pyarrow import fs

        store, _ = _store(path)
        for _ in (p for part in batches for p in part["path"]):
            one = store.get_file_info(top)
            yield from told([one], os.path.dirname(top)) if one.is_file else told(store.get_file_info(fs.FileSelector(top)), top)

    def further(batches):
        from pyarrow import fs

        store, _ = _store(path)
        for part in batches:
            yield part[part["length"] > 0]
            for p in part["path"][part["length"] < 0] if recursive else ():
                for some in told(store.get_file_info(fs.FileSelector(p, recursive=True)), p):
                    yield some[some["length"] > 0]

    entries = spark.createDataFrame([(top,)], "path string").mapInPandas(first, "path string, length bigint")
    dealt = entries.repartition(4 * spark.sparkContext.defaultParallelism, "path")
    return dealt.mapInPandas(further, "path string, length bigint").filter(F.endswith("path", F.lit(suffix))).select(F.concat(F.lit(base), "path").alias("path"), "length")


def file_stems(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """arxiv_id: names without suffix of the files below a folder; contents aren't read."""
    return files_below(spark, path, suffix).select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("arxiv_id"))


def file_checksums(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, md5, length of the files in a folder, read in pieces by the tasks that list them."""
    if _store(path) is None:
        return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", F.md5("content").alias("md5"), "length")

    def summed(batches):
        import hashlib

        for part in batches:
            sums = []
            for p in part["path"]:
                store, at = _store(p)
                total = hashlib.md5()
                with store.open_input_stream(at) as f:
                    while piece := f.read(BLOCK_BYTES):
                        total.update(piece)
                sums.append(total.hexdigest())
            yield part.assign(md5=sums)[["path", "md5", "length"]]

    return files_below(spark, path, recursive=recursive).mapInPandas(summed, "path string, md5 string, length bigint")


def whole_texts(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, value: the files in a folder, a row each, read by the tasks that list them."""
    if _store(path) is None:
        name = F.url_decode(F.regexp_replace(F.input_file_name(), r"\+", "%2B"))  # blanks and the like are told as %20
        return spark.read.option("recursiveFileLookup", recursive).text(path, wholetext=True).select(name.alias("path"), "value")

    def read(batches):
        import pandas as pd

        rows, held = [], 0
        for p in (p for part in batches for p in part["path"]):
            store, at = _store(p)
            with store.open_input_stream(at) as f:
                rows.append((p, f.read().decode("utf-8", "replace")))
            held += len(rows[-1][1]) + 1000
            if held > BLOCK_BYTES:
                yield pd.DataFrame(rows, columns=["path", "value"])
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["path", "value"])

    return files_below(spark, path, recursive=recursive).mapInPandas(read, "path string, value string")


def state_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Progress files, a JSON object each; a broken one gives a row whose status tells so."""
    p = whole_texts(spark, path, recursive).withColumn("s", F.from_json("value", "source string, status string, total_fetched bigint, total_new bigint, last_update string, checksum string, error string, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("s").isNull() | F.col("s._bad").isNotNull()
    return p.select(
        F.coalesce(F.nullif(_text("s.source"), F.lit("")), F.regexp_extract("path", r"([^/]+?)(?:_download_state)?\.json$", 1)).alias("source"),
        F.when(bad, F.concat(F.lit("parse_error: "), tx.clip(F.col("value"), 80))).otherwise(_text("s.status")).alias("status"),
        *(F.coalesce(f"s.{c}", F.lit(0)).alias(c) for c in ("total_fetched", "total_new")), *(_text(f"s.{c}").alias(c) for c in ("last_update", "checksum", "error")),
    )


def jsonl_info(spark: SparkSession, path: str) -> DataFrame:
    """exists, size in MB (one place), lines."""
    files = spark.read.format("binaryFile").load(path).agg(F.round(F.sum("length") / 1e6, 1).alias("size_mb"))
    return files.select(F.lit(True).alias("exists"), "size_mb", F.lit(spark.read.text(path).count()).alias("lines"))


#: Kinds of a dump in the order in which they are looked for.
KINDS = (".jsonl", ".json", ".jsonl.gz", ".json.gz")
#: Bytes of a line block that a task holds at once.
BLOCK_BYTES = 1 << 20
#: Tasks that members are dealt to at most; up to as many members have one each.
MOST_TASKS = 100_000


def _opened(path: str):
    """A file for reading by ranges: nothing of it is read that isn't asked for."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return store.open_input_file(at)


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """path, member, bytes (unpacked), of the zip archives below a folder. Only their directories are read, a task for each archive."""

    def listed(batches):
        import zipfile

        import pandas as pd

        for part in batches:
            for p in part["path"]:
                with _opened(p) as raw, zipfile.ZipFile(raw) as z:
                    yield pd.DataFrame([(p, i.filename, i.file_size) for i in z.infolist() if not i.is_dir()], columns=["path", "member", "bytes"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path).select("path")
    return files.mapInPandas(listed, "path string, member string, bytes bigint")


def member_lines(members: DataFrame) -> DataFrame:
    """path, member, value: the lines of members (path, member), each unpacked as a stream by a task of its own.

    A task reads its member's range of the archive and holds a block of lines. A member is one stream, however large, so
    one task unpacks it; many members are as many tasks. Gzipped members are unpacked twice.
    """

    def unpacked(batches):
        import gzip
        import io
        import zipfile

        import pandas as pd

        for part in batches:
            for p, name in zip(part["path"], part["member"], strict=True):
                with _opened(p) as file, zipfile.ZipFile(file) as z, z.open(name) as raw:
                    lines = io.TextIOWrapper(gzip.open(raw) if name.lower().endswith(".gz") else raw, encoding="utf-8", newline="\n")
                    while some := lines.readlines(BLOCK_BYTES):
                        yield pd.DataFrame({"path": p, "member": name, "value": [x.rstrip("\r\n") for x in some]})

    numbered = members.select("path", "member").withColumn("__at", F.row_number().over(Window.orderBy("path", "member")) - 1)  # names only
    n = max(1, min(members.count(), MOST_TASKS))
    return numbered.repartitionById(n, F.pmod("__at", F.lit(n)).cast("int")).mapInPandas(unpacked, "path string, member string, value string")


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of a downloaded dump below a folder. Of its kinds, also those within zip archives, JSON lines come before JSON, and
    these before gzipped ones; of the first kind there is, the first file by name is read, a member of an archive as a stream of
    its range. No such file is an error.
    """
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").filter("not path like '%.zip'").withColumn("member", F.lit("").cast("string"))
    zipped = archive_members(spark, path).select("path", "member")
    name = F.lower(F.when(F.col("member") == "", F.col("path")).otherwise(F.col("member")))
    rank = F.coalesce(*(F.when(name.endswith(k), i) for i, k in enumerate(KINDS)))
    found = plain.unionByName(zipped).withColumn("rank", rank).filter("rank is not null").orderBy("rank", "path", "member").limit(1).collect()
    if not found:
        raise FileNotFoundError(f"no JSON lines below {path}")
    (one,) = found
    if not one["member"]:
        return spark.read.text(one["path"])
    return member_lines(spark.createDataFrame([(one["path"], one["member"])], "path string, member string")).select("value")


def candidates(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array of candidate papers, or the lines that ``sinks.write_candidates`` gives, with their rank; missing fields get defaults, a
    missing file is an empty table."""
    schema = "arxiv_id string, title string, abstract string, categories array<string>, source string, url string, code_url string, relevance int, md5_abstract string" + ", rank bigint" * lines
    try:
        raw = spark.read.schema(schema).option("multiLine", not lines).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], schema)
    return raw.select(*(F.coalesce(c, F.lit(0)).alias(c) if c in ("relevance", "rank") else F.coalesce(c, F.array().cast("array<string>")).alias(c) if c == "categories" else _text(c).alias(c) for c in raw.columns))


def setting(config: Mapping, dotted: str, default=None):
    """A nested value of a configuration; the default where it is missing or None."""
    at: object = config
    for part in dotted.split("."):
        at = at.get(part) if isinstance(at, Mapping) else None
    return default if at is None else at


def read_config(path: str) -> dict:
    """A YAML file; an absent one is empty."""
    if not os.path.exists(path):
        return {}
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}
