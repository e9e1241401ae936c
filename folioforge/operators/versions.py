"""Numbered versions of a small description below a folder. A number is published once: of two writers only one gets it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer has published this number."""


def _fs(spark: SparkSession, root: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/_versions")
    return jvm, path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The greatest number and what it says; 0 and nothing if there's none."""
    jvm, folder, fs = _fs(spark, root)
    if not fs.exists(folder):
        return 0, {}
    numbers = [int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()]
    if not numbers:
        return 0, {}
    return max(numbers), json.loads(spark.read.text(f"{root}/_versions/{max(numbers):012d}", wholetext=True).first()[0])


def publish(spark: SparkSession, root: str, number: int, content: dict) -> None:
    """Writes the content beside and renames it to its number, which fails where that number exists. A writer that dies leaves all
    earlier versions as they were."""
    jvm, folder, fs = _fs(spark, root)
    fs.mkdirs(folder)
    draft, target = jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(folder, f"{number:012d}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    how = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(how, 1)
    options[0] = how.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), options)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {number} of {root} exists") from e
        raise


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
