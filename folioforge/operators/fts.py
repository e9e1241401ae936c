"""Full-text search: an inverted index as a DataFrame, a small query language, BM25.

The index has a row for each term, document and column. A query reads only the rows of its terms (the files are sorted
by term, so others are pruned), reduces them to one row a document and ranks those.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import stem as stem_word
from ..functions.stem import stems
from ..functions.text import has_category, in_years, let
from ..shared import BROADCAST_ROWS, cut, small, spread

# BM25's parameters and the floor of its inverse document frequency.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
TOKEN = r"[\p{L}\p{N}]+"
#: A term that makes up more than one in so many occurrences is broadcast.
HEAVY = 1000


@dataclass(frozen=True)
class Atom:
    """A term, a phrase (several terms) or a prefix, in one column or any."""

    terms: tuple[str, ...]
    prefix: bool = False
    column: str | None = None


@dataclass(frozen=True)
class Node:
    """op: atom, and, or, not (the first without the second)."""

    op: str
    parts: tuple = ()
    atom: Atom | None = None

    def atoms(self) -> list[Atom]:
        return [self.atom] if self.op == "atom" else [a for p in self.parts for a in p.atoms()]


_LEX = re.compile(r'\s*(?:(\()|(\))|(?:(\w+)\s*:\s*)?(?:"([^"]*)"|([^\s()"]+)))')


def parse(query: str, columns: Sequence[str] = (), stemmed: bool = False) -> Node:
    """Terms side by side mean AND and bind tightest; then NOT, AND, OR. A hyphen parts two terms, which then form a phrase."""
    tokens: list = []
    at = 0
    query = query.strip()
    while at < len(query):
        m = _LEX.match(query, at)
        if not m:
            raise ValueError(f"can't read the query at {query[at:]!r}")
        at = m.end()
        left, right, column, phrase, word = m.groups()
        if left or right:
            tokens.append(left or right)
        elif word in ("AND", "OR", "NOT") and column is None:
            tokens.append(word)
        else:
            if column is not None and columns and column not in columns:
                raise ValueError(f"no such column: {column}")
            text = phrase if phrase is not None else word
            terms = tuple(t.lower() for t in re.findall(r"[^\W_]+", text))
            if not terms:
                continue
            prefix = phrase is None and text.endswith("*")
            if stemmed and not prefix:
                terms = tuple(map(stem_word, terms))
            tokens.append(Node("atom", atom=Atom(terms, prefix, column)))
    if not tokens:
        raise ValueError("the query has no term")
    pos = 0

    def peek():
        return tokens[pos] if pos < len(tokens) else None

    def step():
        nonlocal pos
        pos += 1
        return tokens[pos - 1]

    def primary() -> Node:
        t = step() if peek() is not None else None
        if t == "(":
            out = either()
            if peek() != ")":
                raise ValueError("a parenthesis stays open")
            step()
            return out
        if not isinstance(t, Node):
            raise ValueError(f"a term is missing before {t!r}")
        return t

    def beside() -> Node:
        parts = [primary()]
        while isinstance(peek(), Node) or peek() == "(":
            parts.append(primary())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def without() -> Node:
        out = beside()
        while peek() == "NOT":
            step()
            out = Node("not", (out, beside()))
        return out

    def both() -> Node:
        parts = [without()]
        while peek() == "AND":
            step()
            parts.append(without())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def either() -> Node:
        parts = [both()]
        while peek() == "OR":
            step()
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    tree = either()
    if peek() is not None:
        raise ValueError(f"unexpected {peek()!r}")
    return tree


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def runs(rows: Column, names: Sequence[str], made: Callable[[Column], Column]) -> Column:
    """made(run) of each run of neighbours in a sorted array of structs that agree in the named fields."""

    def of(s: Column) -> Column:
        begins = lambda i: (i == 0) | reduce(lambda a, b: a | b, (F.get(s, i)[n] != F.get(s, i - 1)[n] for n in names))
        at = F.when(F.size(s) == 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0))), begins))
        return let(at, lambda b: F.transform(b, lambda i, k: let(F.slice(s, i + 1, F.coalesce(F.get(b, k + 1), F.size(s)) - i), made)))

    return let(rows, of)


def own_postings(columns: Sequence[str]) -> Column:
    """term, field, tf, places of a document whose columns are arrays of tokens, by term and field: made within its row, so no
    occurrence is shuffled."""
    placed = lambda c: F.transform(c, lambda w, i: F.struct(w.alias("term"), F.lit(c).alias("field"), i.alias("place")))
    row = lambda run: F.struct(run[0]["term"].alias("term"), run[0]["field"].alias("field"), F.size(run).alias("tf"), F.transform(run, lambda x: x["place"]).alias("places"))
    return runs(F.sort_array(F.concat(*map(placed, columns))), ("term", "field"), row)


def split(docs: DataFrame, columns: Sequence[str], *keys: str) -> DataFrame:
    """The keys, the tokens of each column, and length, how many they are."""
    return spread(docs.select(*keys, *columns)).select(*keys, *(tokens(F.col(c)).alias(c) for c in columns)).withColumn("length", reduce(lambda a, c: a + F.size(c), columns, F.lit(0)))


class Index:
    """postings: term, doc, field, tf, places; lengths: doc, length (terms in all columns). Of one that is stemmed and not saved
    also its occurrences (placed: doc, field, place, term), and the stem of each (vocabulary)."""

    placed: DataFrame | None = None
    vocabulary: DataFrame | None = None

    def __init__(self, postings: DataFrame, lengths: DataFrame, columns: Sequence[str], stemmed: bool, saved: bool = False):
        self.postings, self.lengths, self.columns, self.stemmed, self.saved = postings, lengths, tuple(columns), stemmed, saved

    @classmethod
    def build(cls, docs: DataFrame, key: str, columns: Sequence[str] = ("title", "authors", "abstract"), stemmed: bool = True) -> Index:
        """Of deduplicated documents, so a re-imported one is never indexed twice."""
        words = split(docs.select(F.col(key).alias("doc"), *columns), columns, "doc")
        lengths = words.select("doc", "length")
        raw = words.select("doc", F.inline(own_postings(columns))).select("term", "doc", "field", "tf", "places")
        if not stemmed:
            return cls(raw, lengths, columns, stemmed)
        # A row a term, written: a filter on stems then reaches the vocabulary alone, and no occurrence meets the UDF.
        terms = words.select(F.explode(F.concat(*columns)).alias("term"))
        vocabulary = cut(terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).withColumn("stem", stems("term")))
        if vocabulary.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            both = raw.join(F.broadcast(vocabulary.drop("n")), "term")
        else:  # stems of frequent terms, a thousand at most, are broadcast; no other term is a heavy key
            total = vocabulary.agg(F.sum("n")).first()[0]
            frequent = F.broadcast(vocabulary.filter(F.col("n") * HEAVY > total).drop("n"))
            both = raw.join(frequent, "term").unionByName(raw.join(frequent.select("term"), "term", "left_anti").join(vocabulary.filter(F.col("n") * HEAVY <= total).drop("n"), "term"))
        index = cls(cls._by_stem(both), lengths, columns, stemmed)
        each = words.select("doc", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("words")) for c in columns))).alias("f"))
        index.placed, index.vocabulary = each.select("doc", F.col("f.field").alias("field"), F.posexplode("f.words").alias("place", "term")), vocabulary.select("term", "stem")
        return index

    @staticmethod
    def _by_stem(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("stem").alias("term"), "doc", "field").agg(F.sum("tf").cast("int").alias("tf"), F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))

    def save(self, path: str) -> None:
        """Postings in ranges of (term, doc), as many as the shuffle makes of their size; a term of any frequency spans as many
        files as it needs. A query reads the row groups whose range of terms holds its own."""
        self.postings.repartitionByRange("term", "doc").sortWithinPartitions("term", "doc").write.parquet(f"{path}/postings")
        self.lengths.write.parquet(f"{path}/lengths")

    @classmethod
    def load(cls, spark: SparkSession, path: str, columns: Sequence[str] = ("title", "authors", "abstract"), stemmed: bool = True) -> Index:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"), columns, stemmed, saved=True)

    def _rows(self, atoms: Sequence[Atom]) -> DataFrame:
        words = sorted({t for a in atoms if not a.prefix for t in a.terms})
        starts = sorted({a.terms[-1] for a in atoms if a.prefix})
        wanted = lambda t: reduce(lambda c, p: c | F.col(t).startswith(p), starts, F.col(t).isin(words) if words else F.lit(False))
        if self.vocabulary is not None:  # the forms of the wanted stems are few, so only their postings are shuffled
            forms = self.placed.join(small(self.vocabulary.filter(wanted("stem"))), "term")
            return forms.groupBy(F.col("stem").alias("term"), "doc", "field").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.array_sort(F.collect_list("place")).alias("places"))
        return self.postings.filter(wanted("term"))

    def hits(self, tree: Node) -> tuple[DataFrame, list[Atom]]:
        """doc and a frequency f0, f1, ... of each atom, for documents with any; then those that the tree admits."""
        atoms = list(dict.fromkeys(tree.atoms()))
        rows = self._rows(atoms)
        phrases = any(len(a.terms) > 1 for a in atoms)

        def simple(a: Atom) -> Column:
            fit = F.col("term").startswith(a.terms[-1]) if a.prefix else F.col("term") == a.terms[0]
            return F.sum(F.when(fit & ((F.col("field") == a.column) if a.column else F.lit(True)), F.col("tf")).otherwise(0))

        if not phrases:
            out = rows.groupBy("doc").agg(*(simple(a).alias(f"f{i}") for i, a in enumerate(atoms)))
        else:
            terms = sorted({t for a in atoms if len(a.terms) > 1 for t in a.terms})
            by_field = rows.groupBy("doc", "field").agg(
                *(simple(a).alias(f"f{i}") for i, a in enumerate(atoms) if len(a.terms) == 1),
                *(F.flatten(F.collect_list(F.when(F.col("term") == t, F.col("places")))).alias(f"p{k}") for k, t in enumerate(terms)),
            )

            def phrase(a: Atom) -> Column:
                at = [F.col(f"p{terms.index(t)}") for t in a.terms]
                n = F.size(F.filter(at[0], lambda p: reduce(lambda c, j: c & F.array_contains(at[j], p + j), range(1, len(at)), F.lit(True))))
                return F.when(F.col("field") == a.column, n).otherwise(0) if a.column else n

            counted = by_field.select("doc", *((phrase(a) if len(a.terms) > 1 else F.col(f"f{i}")).cast("bigint").alias(f"f{i}") for i, a in enumerate(atoms)))
            out = counted.groupBy("doc").agg(*(F.sum(f"f{i}").alias(f"f{i}") for i in range(len(atoms))))
        return out, atoms

    @staticmethod
    def admits(tree: Node, atoms: list[Atom]) -> Column:
        if tree.op == "atom":
            return F.col(f"f{atoms.index(tree.atom)}") > 0
        parts = [Index.admits(p, atoms) for p in tree.parts]
        return parts[0] & ~parts[1] if tree.op == "not" else reduce((lambda a, b: a & b) if tree.op == "and" else (lambda a, b: a | b), parts)

    def match(self, query: str) -> DataFrame:
        """doc and score (BM25, higher is better) of the documents that match."""
        tree = parse(query, self.columns, self.stemmed)
        hits, atoms = self.hits(tree)
        if not self.saved:  # a row a document of either is written, so texts are read once for each
            hits, self.lengths = cut(hits), cut(self.lengths)
        # One row: how many documents hold each atom, how many there are, and their mean length.
        held = hits.agg(*(F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(atoms))))
        sizes = self.lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"))
        n, size = held.first(), sizes.first()
        docs, mean = size["docs"], float(size["mean"] or 1.0)
        positive = _positive(tree)

        score = reduce(lambda a, b: a + b, (bm25(F.col(f"f{i}"), F.col("length"), idf(docs, n[i]), mean) for i, a in enumerate(atoms) if a in positive))
        return hits.filter(self.admits(tree, atoms)).join(self.lengths, "doc").select("doc", score.alias("score"))


def idf(docs: int, held: int) -> float:
    return max(math.log((docs - held + 0.5) / (held + 0.5)), IDF_FLOOR)


def bm25(frequency: Column, length: Column, weight: float, mean: float) -> Column:
    """What a term adds to a document's score. It rises with the frequency and falls with the length."""
    f = frequency.cast("double")
    return F.lit(weight) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.lit(mean)))


def _positive(tree: Node) -> set[Atom]:
    return {tree.atom} if tree.op == "atom" else _positive(tree.parts[0]) if tree.op == "not" else set().union(*map(_positive, tree.parts))


def search(index: Index, meta: DataFrame, key: str, query: str, limit: int = 10, year_from: int = 0, year_to: int = 0, categories: Sequence[str] = (), sort: str = "relevance") -> DataFrame:
    """The best ``limit`` documents that match and pass the filters; filters come before the limit. sort: relevance or date."""
    passed = meta.filter(in_years(F.col("update_date"), year_from, year_to) & has_category(F.col("categories"), categories))
    found = passed.join(index.match(query).withColumnRenamed("doc", key), key)
    order = [F.desc_nulls_last("update_date"), F.asc(key)] if sort == "date" else [F.desc("score"), F.asc(key)]
    return found.orderBy(*order).limit(limit)


def keyword_search(papers: DataFrame, keyword: str, limit: int = 50) -> DataFrame:
    """Papers whose title or abstract is LIKE %keyword% (any case; % and _ are wildcards), best relevance first."""
    pattern = f"%{keyword}%"
    fit = (F.col("title").ilike(pattern) | F.col("abstract").ilike(pattern)) if keyword else F.lit(True)
    return papers.filter(fit).orderBy(F.desc("relevance"), F.desc("created_at"), F.asc("sf_id")).limit(limit)


def point_lookup(meta: DataFrame, key: str, value) -> DataFrame:
    return meta.filter(F.col(key) == F.lit(value)).limit(1)


def by_dois(meta: DataFrame, dois: Sequence[str]) -> DataFrame:
    """Nothing for an empty list."""
    return meta.filter(F.col("doi").isin(list(dois)) if dois else F.lit(False))


def doi_to_arxiv(dois: DataFrame, meta: DataFrame) -> DataFrame:
    """doi, arxiv_id: the first identifier of each DOI."""
    first = meta.filter("doi <> ''").groupBy("doi").agg(F.min("arxiv_id").alias("arxiv_id"))
    return dois.join(first, "doi", "left").select("doi", F.coalesce("arxiv_id", F.lit("")).alias("arxiv_id"))


def result_record(meta: DataFrame) -> DataFrame:
    """The record that all sources share: address, confidence, clipped text and a hash of the abstract."""
    from ..functions.text import clip, metadata_confidence

    return meta.select(
        "arxiv_id", clip(F.col("title"), 200).alias("title"), clip(F.col("abstract"), 500).alias("abstract"),
        F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id").alias("source_url"), "doi", F.col("journal_ref").alias("venue"),
        metadata_confidence(F.col("doi"), F.col("journal_ref")).alias("confidence"),
        F.when(F.col("abstract") == "", "").otherwise(F.md5(F.col("abstract").cast("binary"))).alias("md5_abstract"),
    )


def index_stats(meta: DataFrame) -> DataFrame:
    """One row: total, with DOI, with journal, with both."""
    has_doi, has_journal = F.col("doi") != "", F.col("journal_ref") != ""
    return meta.agg(F.count(F.lit(1)).alias("total"), F.count_if(has_doi).alias("with_doi"), F.count_if(has_journal).alias("with_journal"), F.count_if(has_doi & has_journal).alias("with_both"))


def years(meta: DataFrame) -> DataFrame:
    return meta.groupBy(F.substring("update_date", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("n"))
