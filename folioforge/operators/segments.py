"""A full-text index that grows: immutable segments, documents that newer ones replace, ranked search that opens few blocks.

A segment holds, for each term and block (1,024 neighbouring documents), the hits of the term there, the greatest
frequency and the shortest length among them. A search first reads those two numbers alone: together with the statistics of the
moment they bound what any document of a block can score. It opens the blocks of the greatest bounds, and of the rest only those
whose bound reaches the k-th score found so far, so the result is that of scoring everything.

Adding a batch writes one segment. Documents that an older segment has too are dead there: a table tells which, and how often
each term is gone with them, so statistics are those of one index of the living. When ``fanout`` segments of about one size have
gathered they are merged into one, without the dead. A version names segments and tables; it is published once (``versions``).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, small
from . import versions
from .fts import Index, Node, _positive, bm25, idf, own_postings, parse, runs, split

#: Documents of a block, as a power of two; blocks that are opened first, and next.
BITS, OPEN = 10, (64, 1024)
#: Rows of a Parquet page, so that one block can be read without its neighbours.
PAGE_ROWS = 64


class Segments:
    def __init__(self, spark: SparkSession, root: str, key: str, columns: Sequence[str] = ("title", "authors", "abstract"), stemmed: bool = True, fanout: int = 4):
        self.spark, self.root, self.key, self.columns, self.stemmed, self.fanout = spark, root, key, tuple(columns), stemmed, fanout

    # ---- growing -----------------------------------------------------------------------------------------------------

    def state(self) -> tuple[int, dict]:
        number, said = versions.latest(self.spark, self.root)
        return number, said or {"segments": [], "dead": [], "dead_docs": 0, "dead_length": 0}

    def _table(self, kind: str, names: Sequence[str]) -> DataFrame | None:
        """A table of several segments, each row with its segment's name."""
        parts = [self.spark.read.parquet(f"{self.root}/{n}/{kind}").withColumn("segment", F.lit(n)) for n in names]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _dead(self, state: dict, kind: str) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.root}/{n}/{kind}") for n in state["dead"]]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _write(self, hits: DataFrame, docs: DataFrame) -> dict:
        """hits: term, block or place, doc, length, tf, fields (array of field, tf, places); docs: doc, place, length, terms. A new segment.

        Hits are dealt by block, and a file holds its blocks by term: so they are shuffled once at most, and not at all if they come
        by block.
        """
        name = f"seg-{uuid.uuid4().hex}"
        if "block" not in hits.columns:
            hits = hits.withColumn("block", F.shiftright("place", BITS)).repartition("block")
        block = hits.groupBy("block", "term")
        blocks = block.agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"), F.collect_list(F.struct("doc", "length", "tf", "fields")).alias("hits"))  # a block's documents at most
        blocks.select("term", "block", "n", "max_tf", "min_length", "hits").sortWithinPartitions("term", "block").write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.root}/{name}/blocks")
        docs.sortWithinPartitions("doc").write.parquet(f"{self.root}/{name}/docs")
        held = self.spark.read.parquet(f"{self.root}/{name}/docs").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("l")).first()
        return {"name": name, "docs": held["n"], "length": int(held["l"] or 0)}

    def add(self, docs: DataFrame) -> int:
        """Documents, one a key; those that the index has are replaced. The number of the new version."""
        number, state = self.state()
        base = docs.select(F.col(self.key).alias("doc"), *self.columns).withColumn("place", F.monotonically_increasing_id())
        if self.stemmed:
            base = cut(base)
            # Postings and lengths carry the place along, so no join is needed to find a document's block.
            made = Index.build(base.withColumn("__doc", F.struct("doc", "place")), "__doc", self.columns, True)
            lengths = cut(made.lengths.select("doc.doc", "doc.place", "length"))
            fields = F.sort_array(F.collect_list(F.struct("field", "tf", "places")))
            by_doc = made.postings.groupBy("term", "doc").agg(F.sum("tf").cast("int").alias("tf"), fields.alias("fields"))
            hits = cut(by_doc.select("term", "doc.*", "tf", "fields").join(lengths.select("place", "length"), "place"))
            terms = hits.groupBy("place").agg(F.collect_set("term").alias("terms"))
            new = self._write(hits, lengths.join(terms, "place", "left"))
        else:  # a document's hits are made within its row, which is shuffled to its block; only these rows are written beside the segment
            whole = lambda run: F.struct(run[0]["term"].alias("term"), F.aggregate(run, F.lit(0), lambda n, x: n + x["tf"]).alias("tf"), F.transform(run, lambda x: F.struct(x["field"], x["tf"], x["places"])).alias("fields"))
            base = cut(split(base, self.columns, "doc", "place").select("doc", "place", "length", runs(own_postings(self.columns), ("term",), whole).alias("hits")))
            hits = base.withColumn("block", F.shiftright("place", BITS)).repartition("block").select("block", "doc", "length", F.inline("hits"))
            new = self._write(hits, base.select("doc", "place", "length", F.col("hits.term").alias("terms")))
        dead = self._bury(state, base.select("doc"))
        after = {"segments": [*state["segments"], new], "dead": [*state["dead"], *dead[:1]], "dead_docs": state["dead_docs"] + dead[1], "dead_length": state["dead_length"] + dead[2]} if dead else state | {"segments": [*state["segments"], new]}
        versions.publish(self.spark, self.root, number + 1, after)
        return number + 1

    def _bury(self, state: dict, docs: DataFrame) -> tuple | None:
        """Writes which living documents of older segments the new ones replace, and the terms that go with them."""
        old = self._table("docs", [s["name"] for s in state["segments"]])
        if old is None:
            return None
        gone = cut(self._living(state, old).join(small(docs), "doc", "left_semi").select("doc", "segment", "length", "terms"))
        n = gone.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("l")).first()
        if not n["n"]:
            return None
        name = f"dead-{uuid.uuid4().hex}"
        gone.select("doc", "segment").write.parquet(f"{self.root}/{name}/docs")
        gone.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{self.root}/{name}/terms")
        return name, n["n"], int(n["l"] or 0)

    def _living(self, state: dict, rows: DataFrame) -> DataFrame:
        """Rows (doc, segment) that no newer segment replaces."""
        dead = self._dead(state, "docs")
        return rows if dead is None else rows.join(small(dead), ["doc", "segment"], "left_anti")

    def merge(self) -> int:
        """Merges segments of about one size where ``fanout`` of them have gathered, until none have. How many merges there were."""
        merges = 0
        while True:
            number, state = self.state()
            tiers: dict[int, list[dict]] = {}
            for s in state["segments"]:
                tiers.setdefault(int(math.log(max(s["docs"], 1), self.fanout)), []).append(s)
            full = next((t for _, t in sorted(tiers.items()) if len(t) >= self.fanout), None)
            if full is None:
                return merges
            self._merged(number, state, [s["name"] for s in full])
            merges += 1

    def _merged(self, number: int, state: dict, names: list[str]) -> None:
        every = self._living(state, self._table("docs", names))
        docs = cut(every.withColumn("place", F.monotonically_increasing_id()))
        # A hit finds its new place by document and segment, which also leaves the dead behind.
        old = self._table("blocks", names).select("term", "segment", F.explode("hits").alias("h")).select("term", "segment", "h.*")
        new = self._write(old.join(docs.select("doc", "segment", "place"), ["doc", "segment"]).drop("segment"), docs.drop("segment"))
        # What was dead in these segments is gone; the rest of the dead, with their terms, is written anew.
        after = {"segments": [*(s for s in state["segments"] if s["name"] not in names), new], "dead": [], "dead_docs": 0, "dead_length": 0}
        dead, left = self._dead(state, "docs"), [s["name"] for s in after["segments"] if s is not new]
        if dead is not None and left:
            gone = cut(self._table("docs", left).join(small(dead), ["doc", "segment"], "left_semi"))
            n = gone.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("l")).first()
            if n["n"]:
                name = f"dead-{uuid.uuid4().hex}"
                gone.select("doc", "segment").write.parquet(f"{self.root}/{name}/docs")
                gone.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{self.root}/{name}/terms")
                after |= {"dead": [name], "dead_docs": n["n"], "dead_length": int(n["l"] or 0)}
        versions.publish(self.spark, self.root, number + 1, after)

    # ---- searching ---------------------------------------------------------------------------------------------------

    def index(self, terms: Sequence[str] = (), starts: Sequence[str] = ()) -> Index:
        """The living as a plain index: all of it, or the postings of some terms and beginnings of terms."""
        _, state = self.state()
        names = [s["name"] for s in state["segments"]]
        blocks = self._table("blocks", names)
        if terms or starts:
            blocks = blocks.filter(reduce(lambda c, p: c | F.col("term").startswith(p), starts, F.col("term").isin(list(terms)) if terms else F.lit(False)))
        hits = self._living(state, blocks.select("term", "segment", F.explode("hits").alias("h")).select("term", "segment", "h.doc", "h.fields"))
        postings = hits.select("term", "doc", F.explode("fields").alias("f")).select("term", "doc", "f.*")
        lengths = self._living(state, self._table("docs", names).select("doc", "segment", "length")).select("doc", "length")
        return Index(postings, lengths, self.columns, self.stemmed, saved=True)

    def search(self, query: str, k: int = 10, report: Callable[[int, int], None] | None = None) -> DataFrame:
        """doc and score of the k best matches; ties by doc. report: gets how many blocks were opened, and how many the terms have."""
        number, state = self.state()
        tree = parse(query, self.columns, self.stemmed)
        atoms = list(dict.fromkeys(tree.atoms()))
        best = lambda df: df.orderBy(F.desc("score"), F.asc("doc")).limit(k)
        if not state["segments"]:
            raise ValueError("the index has no documents")
        if any(a.prefix or a.column or len(a.terms) > 1 for a in atoms):  # bounds are those of single terms
            terms, starts = [t for a in atoms if not a.prefix for t in a.terms], [a.terms[-1] for a in atoms if a.prefix]
            return best(self.index(terms, starts).match(query))
        terms = [a.terms[0] for a in atoms]
        blocks = self._table("blocks", [s["name"] for s in state["segments"]]).filter(F.col("term").isin(terms))
        told = cut(blocks.select("segment", "block", "term", "n", "max_tf", "min_length"))
        held = {r["term"]: int(r["n"]) for r in told.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        gone = self._dead(state, "terms")
        for r in gone.filter(F.col("term").isin(terms)).groupBy("term").agg(F.sum("n").alias("n")).collect() if gone is not None else ():
            held[r["term"]] = held.get(r["term"], 0) - int(r["n"])
        docs = sum(s["docs"] for s in state["segments"]) - state["dead_docs"]
        mean = (sum(s["length"] for s in state["segments"]) - state["dead_length"]) / docs if docs else 1.0
        weight, positive = [idf(docs, held.get(t, 0)) for t in terms], _positive(tree)

        def total(frequency: Callable[[int], Column], length: Callable[[int], Column]) -> Column:
            return reduce(lambda a, b: a + b, (bm25(frequency(i), length(i), weight[i], mean or 1.0) for i, a in enumerate(atoms) if a in positive))

        # A row a block: what a document of it can score at most, if the block has the terms that the query demands.
        most = [F.max(F.when(F.col("term") == t, F.col(c))).alias(f"{c}{i}") for i, t in enumerate(terms) for c in ("max_tf", "min_length")]
        wide = told.groupBy("segment", "block").agg(*most)
        bound = total(lambda i: F.coalesce(F.col(f"max_tf{i}"), F.lit(0)), lambda i: F.coalesce(F.col(f"min_length{i}"), F.lit(0)))
        possible = cut(wide.filter(_possible(tree, atoms)).select("segment", "block", (bound * (1 + 1e-9)).alias("bound")))

        def scored(chosen: DataFrame) -> DataFrame:
            hits = blocks.join(chosen, ["segment", "block"], "left_semi").select("term", "segment", F.explode("hits").alias("h")).select("term", "segment", "h.doc", "h.length", "h.tf")
            f = [F.sum(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"f{i}") for i, t in enumerate(terms)]
            rows = self._living(state, hits).groupBy("doc").agg(F.first("length").alias("length"), *f).filter(Index.admits(tree, atoms))
            return best(rows.select("doc", total(lambda i: F.col(f"f{i}"), lambda i: F.col("length")).alias("score")))

        found, opened, reached = None, 0, None
        left = possible
        for step in (*OPEN, None):
            if reached is not None:
                left = left.filter(F.col("bound") >= F.lit(reached))
            chosen = left if step is None else left.orderBy(F.desc("bound"), "segment", "block").limit(step)
            chosen = cut(chosen)
            n = chosen.count()
            if not n:
                break
            opened += n
            # Of the first steps a fixed number of rows; beyond, the count decides.
            hits = scored(F.broadcast(chosen) if step else small(chosen))
            found = cut(best(hits if found is None else found.unionByName(hits)))
            kth = found.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).first()
            reached = kth["s"] if kth["n"] == k else None
            if step is None or n < step:
                break
            left = left.join(F.broadcast(chosen), ["segment", "block"], "left_anti")
        if report:
            report(opened, wide.count())
        return best(found) if found is not None else self.spark.createDataFrame([], blocks.select(F.explode("hits").alias("h")).select("h.doc").schema.add("score", "double"))


def _possible(tree: Node, atoms: list) -> Column:
    """Whether a block has the terms that any match needs."""
    if tree.op == "atom":
        return F.col(f"max_tf{atoms.index(tree.atom)}").isNotNull()
    parts = [_possible(p, atoms) for p in tree.parts]
    return parts[0] if tree.op == "not" else reduce((lambda a, b: a & b) if tree.op == "and" else (lambda a, b: a | b), parts)
