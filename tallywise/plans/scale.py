"""Building blocks that keep plans sound when one key holds much of the data."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast after its size was counted.
BROADCAST_ROWS = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. Where none is set a temporary one is, but only on a local master (as in tests):
    executors of a cluster don't share a machine's folder.
    """
    have = spark.sparkContext.getCheckpointDir()
    if have:
        return have
    want = spark.conf.get("spark.checkpoint.dir", None)
    if not want:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        want = f"{tempfile.gettempdir()}/tallywise-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(want)
    return spark.sparkContext.getCheckpointDir()


class Temporary:
    """A written table of :func:`materialise`; :func:`clean` deletes it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def delete(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


_WRITTEN: list[Temporary] = []


def clean() -> int:
    """Deletes the tables that were written for queries so far; call it when their results are no longer read. Gives their number."""
    n = len(_WRITTEN)
    while _WRITTEN:
        _WRITTEN.pop().delete()
    return n


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared checkpoint folder and read again.

    Cuts the lineage, survives the loss of executors, and keeps only compressed
    columns on disk. The row order and partitioning aren't kept. The table stays until
    :func:`clean`, since a lazy result may still read it.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    _WRITTEN.append(Temporary(df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


_METHOD = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs in this context don't fuse expressions into methods that the JVM won't compile.

    The JVM only interprets methods of more than 8,000 bytes; wide expressions run
    several times faster as many small methods. The setting is put back.
    """
    old = spark.conf.get(_METHOD)
    spark.conf.set(_METHOD, "8000")
    try:
        yield
    finally:
        spark.conf.set(_METHOD, old)


def small_or_none(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``most`` rows; counts no further than that."""
    return df.limit(most + 1).count() <= most


def join_checked(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts ``right`` only after counting it.

    Beyond ``most`` rows it is a shuffled join, whose skewed partitions AQE splits.
    """
    return left.join(F.broadcast(right) if small_or_none(right, most) else right, list(on), how)


def dense_partitions(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` range-partitioned on keys and order, with its partition number ``__pid``, frozen.

    A key of any size is spread over as many partitions as its rows need.
    """
    cols = [*[F.col(k) for k in keys], *order]
    return materialise(df.repartitionByRange(*cols).withColumn("__pid", F.spark_partition_id()))
