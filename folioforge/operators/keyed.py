"""Rewrites of keyed tables as pure functions (old, changes) -> new. Rows come in order of an ``ordinal`` column.

Plain files take no MERGE: write the result to a new version and swap the pointer (``publish``), never onto the path read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key, by partial aggregation of one struct: a hot key is one row a task before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    lead = [(F.col(c) if isinstance(c, str) else c).alias(f"__o{i}") for i, c in enumerate(order)]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*lead, *(F.col(f"`{c}`") for c in others))).alias("__first"))
    return picked.select(*(F.col(f"`{c}`") if c in keys else F.col(f"__first.`{c}`").alias(c) for c in df.columns))


def keep_first(df: DataFrame, key: str = "arxiv_id", order: str = "ordinal") -> DataFrame:
    """The first row of each key in order of ordinal; rows with an empty key go."""
    return first_by(df.filter((F.col(key) != "") & F.col(key).isNotNull()), [key], [order])


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str = "ordinal") -> DataFrame:
    """old and the first of each new key that old lacks."""
    return old.unionByName(new_rows(old, new, keys, order))


def new_rows(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str = "ordinal") -> DataFrame:
    """The first of each new key that old lacks, with old's columns."""
    return first_by(new.join(old.select(*keys).distinct(), list(keys), "left_anti"), keys, [order]).select(*old.columns)


def upsert(old: DataFrame, changes: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of ``changes`` (one a key) replace old ones but for the columns to keep; others are inserted."""
    n = changes.withColumns({f"__{c}": F.col(f"`{c}`") for c in changes.columns}).select(key, *(f"__{c}" for c in changes.columns), F.lit(True).alias("__hit"))
    both = old.withColumn("__old", F.lit(True)).join(n, key, "full_outer")
    pick = lambda c: F.when(F.col("__hit") & (F.col("__old").isNull() | F.lit(c not in keep)), F.col(f"__{c}")).otherwise(F.col(f"`{c}`")) if c in changes.columns else F.col(f"`{c}`")
    return both.select(*(F.col(key) if c == key else pick(c).alias(c) for c in old.columns))


def latest_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(F.col(order).alias("__order"), *others)).alias("__m")).select(*(F.col(key) if c == key else F.col(f"__m.`{c}`").alias(c) for c in df.columns))


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """df with each row's place from 1 in the whole order. A distributed sort gives its place in a partition, the partitions' sizes the
    rest; the sorted rows are written, so both readings see the same partitions."""
    within = F.lit((1 << 33) - 1)  # what monotonically_increasing_id counts within a partition
    rows = cut(df.sort(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    before, starts = 0, []
    for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row a partition
        starts.append((r["part"], before))
        before += r["n"]
    offsets = df.sparkSession.createDataFrame(starts, "__part bigint, __before bigint")
    return rows.join(F.broadcast(offsets), part == F.col("__part")).withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(within) + 1).drop("__at", "__part", "__before")


def publish(df: DataFrame, root: str, spark: SparkSession | None = None) -> str:
    """Writes a new version below root and points to it; earlier versions stay for readers that still use them."""
    import uuid

    spark = spark or df.sparkSession
    version = f"{root}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{root}/_current")
    return version


def current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(spark.read.text(f"{root}/_current").first()[0])
