"""Scalar functions over bibliographic text: all of them Column to Column, inside whole-stage code."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier patterns.
ARXIV_ID = r"(\d{4}\.\d{4,5})(?:v\d+)?"
ARXIV_ID_WHOLE = r"^\d{4}\.\d{4,5}(?:v\d+)?$"
DOI = r"10\.\d{4,}/[^\s]+"


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# ---- identifiers -----------------------------------------------------------------------------------------------------


def arxiv_id(x: Column) -> Column:
    """The first arXiv identifier without its version, wherever it stands; '' if none."""
    return F.regexp_extract(x, ARXIV_ID, 1)


def arxiv_id_prefixed(x: Column) -> Column:
    """As arxiv_id, but only after ``arxiv:``, ``/abs/`` or ``/pdf/``, or bare; case doesn't matter."""
    return F.regexp_extract(x, r"(?i)(?:arxiv[:\s]*|/abs/|/pdf/)?(\d{4}\.\d{4,5})", 1)


def is_arxiv_id(x: Column) -> Column:
    return F.coalesce(x.rlike(ARXIV_ID_WHOLE), F.lit(False))


def doi(x: Column) -> Column:
    """The first DOI, up to the next white space."""
    return F.regexp_extract(x, DOI, 0)


def bare_id(x: Column) -> Column:
    """An identifier without version suffix and without what stands before its last slash."""
    return F.element_at(F.split(F.regexp_replace(x, r"v\d+$", ""), "/"), -1)


def arxiv_year(x: Column) -> Column:
    """The year that the identifier's first two digits tell (99 is 2099); 0 without them."""
    return F.when(x.rlike("^[0-9]{2}"), F.substring(x, 1, 2).cast("int") + 2000).otherwise(0)


# ---- text ------------------------------------------------------------------------------------------------------------


def clip(x: Column, n: int) -> Column:
    """The first n characters."""
    return F.substring(x, 1, n)


def normalized_title(x: Column) -> Column:
    """Lower case, without anything but letters, digits and underscores of any script, blanks single and trimmed."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)[^\w\s]", ""), r"(?U)\s+", " ")))


def exact_match(a: Column, b: Column) -> Column:
    return normalized_title(a) == normalized_title(b)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: within a higher-order function a plain column is computed again at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trigrams(x: Column) -> Column:
    """Distinct 3-character pieces of the title's lower-case ASCII letters, digits and blanks."""
    pieces = lambda p: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - 2, F.lit(1))), lambda i: F.substr(p, i, F.lit(3))))
    return let(F.regexp_replace(F.lower(F.trim(x)), r"[^a-z0-9\s]", ""), lambda p: F.when(F.length(p) < 3, F.array().cast("array<string>")).otherwise(pieces(p)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; 0 if either is empty."""

    def of(s: Column) -> Column:
        sizes = F.size(s["a"]) + F.size(s["b"])
        share = lambda both: both.cast("double") / (sizes - both)
        return F.when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), 0.0).otherwise(let(F.size(F.array_intersect(s["a"], s["b"])), share))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def year_of(date: Column) -> Column:
    """The first four characters as a number; null if they are none."""
    return F.when(F.substring(date, 1, 4).rlike("^[0-9]{4}$"), F.substring(date, 1, 4).cast("int"))


def in_years(date: Column, first: int = 0, last: int = 0) -> Column:
    """Within the years, 0 for no bound. A date without a year passes."""
    y, out = year_of(date), F.lit(True)
    if first:
        out = out & (y.isNull() | (y >= first))
    if last:
        out = out & (y.isNull() | (y <= last))
    return out


def has_category(categories: Column, wanted: Sequence[str]) -> Column:
    """Whether any of the blank-separated categories is wanted; nothing wanted admits all."""
    return F.arrays_overlap(F.split(F.trim(categories), r"\s+"), F.array(*map(F.lit, wanted))) if wanted else F.lit(True)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, w: a | text.contains(w), words, F.lit(False))


def keyword_score(text: Column, high: Sequence[str] = (), medium: Sequence[str] = (), low: Sequence[str] = ()) -> Column:
    """20, 10 or 5 for each listed keyword that the (lower-case) text contains, at most 100."""
    parts = [F.when(text.contains(w), n).otherwise(0) for words, n in ((high, 20), (medium, 10), (low, 5)) for w in words]
    return F.least(F.lit(100), reduce(lambda a, b: a + b, parts, F.lit(0)))


def phrase_score(text: Column, phrases: Sequence[str] = ()) -> Column:
    """15 for each phrase, at most 80."""
    return F.least(F.lit(80), reduce(lambda a, w: a + F.when(text.contains(w), 15).otherwise(0), phrases, F.lit(0)))


def relevance(title: Column, abstract: Column, high: Sequence[str] = (), medium: Sequence[str] = (), low: Sequence[str] = (), phrases: Sequence[str] = (), excluded: Sequence[str] = ()) -> Column:
    """0 for excluded text; the keyword score if it is 60 or more; else the better of keyword and phrase score."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(abstract, F.lit(""))))
    words = keyword_score(text, high, medium, low)
    return F.when(contains_any(text, excluded), 0).when(words >= 60, words).otherwise(F.least(F.lit(100), F.greatest(words, phrase_score(text, phrases)))).cast("int")


def stars_1_to_5(text: Column, high: Sequence[str], medium: Sequence[str]) -> Column:
    """One, plus one for each high and a half for each medium keyword, whole numbers up to five."""
    parts = [F.when(text.contains(w), n).otherwise(0.0) for words, n in ((high, 1.0), (medium, 0.5)) for w in words]
    return F.least(F.lit(5), F.floor(reduce(lambda a, b: a + b, parts, F.lit(1.0))).cast("int"))


def status_of(score: Column) -> Column:
    return F.when(score >= 0.70, "VERIFIED").when(score >= 0.40, "SUSPECTED").otherwise("NOT_FOUND")


def metadata_confidence(doi_: Column, venue: Column) -> Column:
    return F.when((doi_ != "") & (venue != ""), 0.9).when(doi_ != "", 0.6).otherwise(0.3)


def confidence_europepmc(doi_: Column, has_pdf: Column, cited: Column) -> Column:
    """0.3, 0.3 for a DOI, 0.2 for a PDF and up to 0.2 for citations."""
    return F.least(F.lit(1.0), 0.3 + F.when(doi_ != "", 0.3).otherwise(0.0) + F.when(has_pdf == "Y", 0.2).otherwise(0.0) + F.least(cited / 100.0, F.lit(0.2)))


def confidence_s2(doi_: Column, arxiv: Column, pdf: Column, cited: Column) -> Column:
    """0.3, 0.2 each for DOI, arXiv id and PDF, and up to 0.1 for citations."""
    yes = lambda c: F.when(c != "", 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), 0.3 + yes(doi_) + yes(arxiv) + yes(pdf) + F.least(cited / 200.0, F.lit(0.1)))


def code_level(stars: Column, least: int = 3) -> Column:
    """5 from 100 stars, 4 from 10, else the source's least level."""
    return F.when(stars >= 100, 5).when(stars >= 10, 4).otherwise(least)


def repo_overlap(title: Column, described: Column) -> Column:
    """The share of the title's distinct words of over three letters that the repository's text contains."""
    words = F.array_distinct(F.filter(F.split(F.lower(title), r"\s+"), lambda w: F.length(w) > 3))
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.filter(words, lambda w: F.lower(described).contains(w))) / F.size(words))


# The shapes of keywords, capitalised words (also joined ones) and technical terms.
CAPITALISED = r"[A-Z][a-z]+(?:[-/][A-Z][a-z]+)*"
TERMS = r"\b(?:PDE|FNO|DeepONet|PINN|GAN|Transformer|CNN|RNN|MLP|ViT|INR|SOTA)\b"


def keywords(text: Column, most: int = 15) -> Column:
    """The first ``most`` distinct words of three letters or more of either shape, capitalised ones first; longest first, then by text."""
    words = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (CAPITALISED, TERMS)))
    by = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.array_sort(F.slice(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3)), 1, most), by)


# The address of a repository, a link to one whose text is Code, a link of a class with code in its name. Case doesn't matter.
REPOSITORY = r"""(?:https?://)?(?:www\.)?github\.com/([A-Za-z0-9._-]+/[A-Za-z0-9._/-]+?)(?:\s|\.|\"|'|<|>|\)|,|$|\))"""
LABELLED_LINK = r'<a[^>]*href="(https?://github\.com/[^"]+)"[^>]*>\s*Code\s*</a>'
CLASSED_LINK = r'<a[^>]*class="[^"]*code[^"]*"[^>]*href="([^"]+)"'


def github_url(html: Column) -> Column:
    """The repository that a page links; '' if none. Case of tags doesn't matter.

    Tried in turn: a link to the host whose text is Code, any address of a repository (in a block of code links or elsewhere), a
    link of a class with code in its name whose address has github in it. A trailing slash and ``.git`` go.
    """
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, "/+$", ""), r"\.git$", "")
    get = lambda p: F.nullif(F.regexp_extract(html, "(?i)" + p, 1), F.lit(""))
    labelled, classed = get(LABELLED_LINK), get(CLASSED_LINK)
    anywhere = F.concat(F.lit("https://github.com/"), bare(get(REPOSITORY)))
    return F.coalesce(bare(labelled), anywhere, F.when(F.lower(classed).contains("github"), F.regexp_replace(classed, "/+$", "")), F.lit(""))


def hosted_code_url(text: Column) -> Column:
    """Owner and name of a repository on one of three hosts, written as a github.com address."""
    m = F.regexp_extract(text, r"(?:github|gitlab|bitbucket)\.(?:com|org)/([A-Za-z0-9_.\-]+/[A-Za-z0-9_.\-]+)", 1)
    return F.when(m == "", "").otherwise(F.concat(F.lit("https://github.com/"), m))


def links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), F.lit(1)))


def nested_text(payload: Column, field: str) -> Column:
    """A field of a JSON text that is plain or wrapped as {value} or {content}; '' if absent."""
    get = lambda p: F.get_json_object(payload, f"$.{field}{p}")
    return F.coalesce(get(".value"), get(".content"), get(""), F.lit(""))


def venue_year(venue: Column, year: Column) -> Column:
    """``venue (year)``; without a year just the venue."""
    return F.when(F.coalesce(venue, F.lit("")) == "", "").when(year.isNull() | (year.cast("string") == ""), venue).otherwise(F.concat(venue, F.lit(" ("), year.cast("string"), F.lit(")")))


def bibtex(arxiv: Column, title: Column, authors: Column, year: Column, doi_: Column) -> Column:
    """A BibTeX entry; its key is the first author's last word and the year, else arxiv and the identifier's digits."""
    first = F.trim(F.element_at(F.split(authors, ","), 1))
    last = F.regexp_replace(F.lower(F.element_at(F.split(first, r"\s+"), -1)), "[^a-z0-9]", "")
    digits = F.regexp_replace(arxiv, "[^0-9]", "")
    key = F.when(last == "", F.concat(F.lit("arxiv"), digits)).otherwise(F.concat(last, year.cast("string")))
    return F.concat(
        F.lit("@article{"), key, F.lit(", title={"), F.trim(F.regexp_replace(title, "[{}\n]", " ")), F.lit("}, author={"), F.regexp_replace(authors, ", ", " and "),
        F.lit("}, year={"), year.cast("string"), F.lit("}, eprint={"), arxiv, F.lit("}"), F.when(doi_ == "", "").otherwise(F.concat(F.lit(", doi={"), doi_, F.lit("}"))), F.lit("}"),
    )


def reference_line(arxiv: Column, title: Column, authors: Column, year: Column) -> Column:
    """Authors (the first one and "et al." beyond three), year, title, identifier."""
    parts = F.split(authors, ",")
    who = F.when(F.size(parts) > 3, F.concat(F.trim(F.element_at(parts, 1)), F.lit(" et al."))).otherwise(authors)
    return F.concat(who, F.lit(" ("), year.cast("string"), F.lit("). "), title, F.lit(". arXiv:"), arxiv)


def human_bytes(x: Column) -> Column:
    """Bytes of a size such as 4.5G, 12 KiB or 300: powers of 1024; null if it is none."""
    n = F.nullif(F.regexp_extract(x, r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*([kmgt]?)(?:i?b)?\s*$", 1), F.lit("")).cast("double")
    unit = F.lower(F.regexp_extract(x, r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*([kmgt]?)(?:i?b)?\s*$", 2))
    power = F.when(unit == "k", 1).when(unit == "m", 2).when(unit == "g", 3).when(unit == "t", 4).otherwise(0)
    return F.floor(n * F.pow(F.lit(1024.0), power)).cast("bigint")


def progress(now: Column, total: Column) -> Column:
    """Whole percent, 99 at most; 0 of nothing."""
    return F.least(F.lit(99), F.coalesce(F.floor(F.try_divide(now, total) * 100).cast("int"), F.lit(0)))


def date_range(first: Column, last: Column) -> Column:
    return F.concat_ws(":", first, last)


def date_range_parts(x: Column) -> Column:
    """[from, to], or null unless there are exactly two parts."""
    parts = F.split(x, ":")
    return F.when(F.size(parts) == 2, parts)


def backoff(attempt: Column, base: float, most: float) -> Column:
    """Seconds to wait before an attempt (1, 2, ...)."""
    return F.least(_lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))


def usage_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    return tokens_in * price_in + tokens_out * price_out


def within_budget(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float, most_tokens: int, most_cost: float) -> Column:
    """A free model always passes; else both tokens and cost must stay within their limits."""
    if not price_in and not price_out:
        return F.lit(True)
    return (tokens_in + tokens_out <= most_tokens) & (usage_cost(tokens_in, tokens_out, price_in, price_out) <= most_cost)


# ---- snowflake ids ---------------------------------------------------------------------------------------------------

# Epoch of the ids and their bits.
SNOWFLAKE_EPOCH_MS = 1728000000000
WORKER_BITS = SEQUENCE_BITS = 6
FIRST_SEQUENCE = 5


def snowflake(ms: Column, worker: Column, sequence: Column) -> Column:
    """Milliseconds since the epoch, worker and sequence in one number. sequence must lie below 64."""
    since = ms - SNOWFLAKE_EPOCH_MS
    return F.shiftleft(since.cast("bigint"), WORKER_BITS + SEQUENCE_BITS) + F.shiftleft(worker.cast("bigint"), SEQUENCE_BITS) + sequence.cast("bigint")


def snowflake_ms(sf_id: Column) -> Column:
    return F.shiftright(sf_id, WORKER_BITS + SEQUENCE_BITS) + SNOWFLAKE_EPOCH_MS


def snowflake_worker(sf_id: Column) -> Column:
    return F.shiftright(sf_id, SEQUENCE_BITS).bitwiseAND(F.lit((1 << WORKER_BITS) - 1))


def snowflake_sequence(sf_id: Column) -> Column:
    return sf_id.bitwiseAND(F.lit((1 << SEQUENCE_BITS) - 1))


# ---- citations in prose ----------------------------------------------------------------------------------------------

# The two shapes of a citation by title.
TITLE_FIRST = r'"([^"]+)"\s*\(([A-Z][a-z]+(?:\s+(?:et\s+al\.?|&\s+[A-Z][a-z]+))?)\s*,?\s*(\d{4})\)'
AUTHOR_FIRST = r'([A-Z][a-z]+(?:\s+(?:et\s+al\.?|&\s+[A-Z][a-z]+))?)\s*\((\d{4})\)\s*["\u201c]([^"\u201d]+)["\u201d]'


def citations(text: Column) -> Column:
    """array<struct<type, id, authors, year, title>>: arXiv identifiers, then title-first, then author-first citations."""

    def made(kind: str, id_: Column, authors: Column, year: Column, title: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), id_.alias("id"), authors.alias("authors"), year.alias("year"), title.alias("title"))

    none = F.lit("")
    ids = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(ARXIV_ID), F.lit(1))), lambda x: made("arxiv", x, none, F.lit(0), none))

    def shaped(pattern: str, author: int, year: int, title: int) -> Column:
        return F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda m: made("author-year-title", none, F.trim(F.regexp_extract(m, pattern, author)), F.regexp_extract(m, pattern, year).cast("int"), F.trim(F.regexp_extract(m, pattern, title))),
        )

    return F.concat(ids, shaped(TITLE_FIRST, 2, 3, 1), shaped(AUTHOR_FIRST, 1, 2, 3))
