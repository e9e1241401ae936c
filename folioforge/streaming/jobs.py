"""Structured Streaming: incremental pulls, deduplication, event counts, item chains."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.buckets import Buckets
from ..operators.keyed import new_rows


def pages(spark: SparkSession, path: str, schema: str, form: str = "json", per_trigger: int = 100, **options: str) -> DataFrame:
    """Pages as they are put into a folder, a bounded number of files a micro-batch."""
    return spark.readStream.format(form).schema(schema).options(**options).option("maxFilesPerTrigger", per_trigger).load(path)


def dedup(stream: DataFrame, keys: Sequence[str], time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark; state is dropped after it, so a later copy counts as new."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def event_counts(stream: DataFrame, keys: Sequence[str] = ("event", "status")) -> DataFrame:
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(stream: DataFrame, time: str, window: str, late: str, keys: Sequence[str] = ("event",)) -> DataFrame:
    """An extension: counts of tumbling windows; late rows within the watermark count."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))


def chain(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One transformation of several, for a stream or a batch."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = step(df)
        return df

    return run


def into_store(stream: DataFrame, read: Callable[[], DataFrame], append: Callable[[DataFrame], None], keys: Sequence[str], checkpoint: str, every: str | None = None, report: Callable[[int, int, int], None] | None = None) -> StreamingQuery:
    """Micro-batches into a keyed store: the first of each key wins; known keys are ignored, and only new rows are appended.

    every: a processing-time trigger such as "15 minutes"; without it what is there is worked off and the query ends.
    Offsets live in the checkpoint, so a restart resumes; a batch that runs again appends nothing twice, as its keys are known by then.
    report: gets batch id, rows seen and rows new (increments, never running totals).
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("ordinal", F.monotonically_increasing_id()) if "ordinal" not in batch.columns else batch
        batch = batch.persist()
        fresh = new_rows(read(), batch, keys).persist()
        try:
            n = fresh.count()
            if n:
                append(fresh)
            if report:
                report(batch_id, batch.count(), n)
        finally:
            fresh.unpersist()
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def into_buckets(stream: DataFrame, store: Buckets, checkpoint: str, every: str | None = None, report: Callable[[int, dict], None] | None = None) -> StreamingQuery:
    """As into_store, into a table in hash buckets: a micro-batch reads the buckets of its own keys alone and adds files to them.

    A batch that runs again finds its keys there and adds nothing. report: gets batch id and what ``Buckets.insert`` tells.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        told = store.insert(batch if "ordinal" in batch.columns else batch.withColumn("ordinal", F.monotonically_increasing_id()))
        if report:
            report(batch_id, told)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def harvest(fetch: Callable[[str | None], tuple[DataFrame, str | None] | None], read: Callable[[], DataFrame], append: Callable[[DataFrame], None], keys: Sequence[str] = ("arxiv_id",), most_pages: int = 0, report: Callable[[int, int, int], None] | None = None) -> int:
    """Pages by resumption token: fetch(token) gives a page's rows and the next token; None, no rows or no token ends it.

    Each page's rows that the store lacks are appended before the next page is asked for. most_pages: 0 for all. report: gets
    page, rows and new rows. The number of new rows.
    """
    token, page, new = None, 0, 0
    while not most_pages or page < most_pages:
        got = fetch(token)
        if got is None or got[0].isEmpty():
            break
        page += 1
        rows, token = got
        rows = rows.withColumn("ordinal", F.monotonically_increasing_id()) if "ordinal" not in rows.columns else rows
        fresh = new_rows(read(), rows, keys).persist()
        n = fresh.count()
        if n:
            append(fresh)
        fresh.unpersist()
        new += n
        if report:
            report(page, rows.count(), n)
        if not token:
            break
    return new


def drain(pull: Callable[[], DataFrame], work: Callable[[DataFrame], None]) -> int:
    """Batches until a pulled one is empty; how many there were."""
    n = 0
    while not (batch := pull()).isEmpty():
        work(batch)
        n += 1
    return n


def to_table(stream: DataFrame, mode: str, checkpoint: str, path: str) -> DataFrame:
    """What the stream has given when all that is there is worked off. Each micro-batch is a folder of Parquet files below path.

    mode append: all batches together; complete: the last one. A batch that runs again replaces its own folder.
    """
    last: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        last.append(batch_id)

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/batch={last[-1]}" if mode == "complete" else f"{path}/batch=*")
