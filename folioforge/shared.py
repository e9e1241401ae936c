"""The folder that driver and executors share, tables that cut lineage, and joins' checked sizes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few bytes a row may be broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 200_000
_OWN: list[str] = []
_CUTS: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new path below the cluster's ``spark.checkpoint.dir``; below a temporary folder only where that is unset and the master is local."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="folioforge-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        given = _OWN[0]
    return f"{given}/folioforge-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder."""
    path = folder(df.sparkSession)
    _CUTS.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> int:
    """Deletes the tables that this process has cut; results that still read them must have been written before. How many there were."""
    n = len(_CUTS)
    while _CUTS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (narrow rows) with a broadcast hint if it is counted to have at most that many rows; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if its files make fewer partitions than there are; as it is on larger inputs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
