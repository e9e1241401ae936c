"""A keyed table in hash buckets: a change reads and rewrites the buckets that its keys fall into, and no others.

A version is a list of folders for each bucket. A rewrite puts new folders in place of those it has read; an insertion adds
one. All other buckets keep their files. A version is published under the next number, which only one writer gets; one that
comes second starts again from the new state. Old folders stay for readers of old versions until ``vacuum``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions
from .keyed import latest_by, new_rows, upsert

BUCKET = "__bucket"


class Buckets:
    def __init__(self, spark: SparkSession, root: str, schema: str, keys: Sequence[str], buckets: int = 64, attempts: int = 5):
        """buckets: counts when the table begins; later its own number holds. Size them to some hundred MB each."""
        self.spark, self.root, self.schema, self.keys, self.attempts = spark, root, schema, list(keys), attempts
        self.buckets = versions.latest(spark, root)[1].get("buckets", buckets)

    def _state(self) -> tuple[int, dict[str, list[str]]]:
        number, said = versions.latest(self.spark, self.root)
        return number, said.get("folders", {})

    def _read(self, folders: dict[str, list[str]], which: Sequence[int] | None = None) -> DataFrame:
        paths = [p for b, at in folders.items() if which is None or int(b) in which for p in at]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, which: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        return self._read(self._state()[1], which)

    def bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def touched(self, changes: DataFrame) -> list[int]:
        """The buckets that changes fall into: at most as many rows as there are buckets."""
        return sorted(r[0] for r in self.bucketed(changes).select(BUCKET).distinct().collect())

    def _written(self, rows: DataFrame) -> dict[str, str]:
        """Folders by bucket of rows written below a new one."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        self.bucketed(rows).repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()]
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith(BUCKET + "=")}

    def _change(self, changes: DataFrame, made: Callable[[DataFrame, DataFrame], DataFrame], replace: bool) -> dict:
        changes = changes.persist()
        try:
            which = self.touched(changes)
            for _ in range(self.attempts):
                number, folders = self._state()
                new = self._written(made(self._read(folders, which), changes))
                kept = {b: at for b, at in folders.items() if not replace or int(b) not in which}
                after = {b: kept.get(b, []) + ([new[b]] if b in new else []) for b in kept.keys() | new.keys()}
                try:
                    versions.publish(self.spark, self.root, number + 1, {"buckets": self.buckets, "folders": after})
                    return {"version": number + 1, "touched": which, "folders_read": sum(len(folders.get(str(b), [])) for b in which), "folders": sum(map(len, folders.values()))}
                except versions.Conflict:
                    for path in new.values():
                        versions.delete(self.spark, path)
            raise versions.Conflict(f"{self.root}: {self.attempts} attempts met other writers")
        finally:
            changes.unpersist()

    def upsert(self, changes: DataFrame, keep: Sequence[str] = (), order: str | None = None) -> dict:
        """Rows replace those of their key but for the columns to keep; others are inserted. order: the last row of a key counts, else
        keys must be single. A table of one key column."""
        (key,) = self.keys
        last = latest_by(changes, key, order) if order else changes
        return self._change(last, lambda old, new: upsert(old, new, key, keep), True)

    def insert(self, rows: DataFrame, order: str = "ordinal") -> dict:
        """The first row of each key that the table lacks."""
        return self._change(rows, lambda old, new: new_rows(old, new, self.keys, order), False)

    def rewrite(self, changes: DataFrame, made: Callable[[DataFrame, DataFrame], DataFrame]) -> dict:
        """made(old rows of the touched buckets, changes) are the new rows of these buckets."""
        return self._change(changes, made, True)

    def compact(self, most: int = 8) -> list[int]:
        """Buckets of more than ``most`` folders become one folder each."""
        number, folders = self._state()
        which = [int(b) for b, at in folders.items() if len(at) > most]
        if which:
            new = self._written(self._read(folders, which))
            after = {b: at for b, at in folders.items() if int(b) not in which} | {b: [p] for b, p in new.items()}
            versions.publish(self.spark, self.root, number + 1, {"buckets": self.buckets, "folders": after})
        return which

    def vacuum(self) -> int:
        """Deletes folders that the present version doesn't name; to be called when no reader uses an older one and no writer is at work."""
        held = {p.rsplit("/", 2)[1] for at in self._state()[1].values() for p in at}
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/data")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = [f.getPath().toString() for f in fs.listStatus(at) if f.getPath().getName() not in held] if fs.exists(at) else []
        for path in gone:
            versions.delete(self.spark, path)
        return len(gone)
