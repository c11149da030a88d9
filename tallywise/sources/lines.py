"""Numbered lines of text files of any size."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywise.plans.ordered import Ordered

_TRIM = r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$"


def _file_system(spark: SparkSession, url: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(url)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, url: str) -> bool:
    """Whether there is a file or folder of that URL."""
    fs, at = _file_system(spark, url)
    return fs.exists(at)


def text_files(spark: SparkSession, url: str, end: str) -> list[str]:
    """Files below a URL by their Hadoop file system, recursively, as object stores list them in few calls."""
    fs, at = _file_system(spark, url)
    found, it = [], fs.listFiles(at, True)
    while it.hasNext():
        name = it.next().getPath().toString()
        if name.endswith(end):
            found.append(name)
    return sorted(found)


def jsonl_files(root: str, spark: SparkSession | None = None) -> list[str]:
    """All ``*.jsonl`` below a folder or URL, also those with hidden names; unreadable folders count as empty."""
    if "://" in root:
        return text_files(spark, root, ".jsonl")
    found = []
    for base, _, names in os.walk(root, followlinks=True):
        found += [os.path.join(base, n) for n in names if n.endswith(".jsonl")]
    return sorted(found)


def numbered_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file_path, modified_at, line, body): the lines that aren't blank, trimmed, numbered from 1 in each file.

    Files are split like any text file; the numbers come from a running count over
    the offset of the block and the order in it, so that a large file is no single
    task. A file whose bytes aren't UTF-8 gives no line; the character U+FFFD may stand in one that is.
    """
    if not paths:
        return spark.createDataFrame([], "file_path string, modified_at timestamp, line int, body string")
    t = spark.read.text(list(paths), lineSep="\n").select(
        F.expr("url_decode(replace(regexp_replace(_metadata.file_path, '^file:/+', '/'), '+', '%2B'))").alias("file_path"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.regexp_replace("value", _TRIM, "").alias("body"),
        F.is_valid_utf8("value").alias("_valid"),
    )
    t = t.withColumn("_at", F.monotonically_increasing_id())
    o = Ordered(t.where("body <> ''"), ["file_path"], ["_block", "_at"]).running(sums={"line": F.lit(1)})
    d = o.df.withColumn("line", F.col("line").cast("int")).drop("_block", "_at")
    broken = d.where("not _valid").select("file_path").distinct()
    return d.drop("_valid").join(broken, "file_path", "left_anti")
