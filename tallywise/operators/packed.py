"""Several values packed in one field: one row per value, position kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.functions.packed import with_values


def explode_packed(df: DataFrame, key: str, field: str, pos: str = "pos", value: str = "value", keep_single: bool = True) -> DataFrame:
    """One row (key, pos, value) per value of ``field``; ``pos`` counts from 1.

    Null, empty and valueless fields give no row. Keys may repeat or be null: each
    row of ``df`` is split by itself. Other columns of ``df`` are not read, so
    their names can't clash. With ``keep_single`` false, fields of one value are
    left out. A narrow operation: no shuffle, one pass.
    """
    d = df.select(F.col(key).alias("k"), F.col(field).alias("f")).where(F.col("f").isNotNull() & (F.trim("f") != ""))
    if not keep_single:
        # Two values need something between them.
        d = d.where(F.col("f").rlike(r"[^\p{L}\p{N}_]"))
    d = with_values(d, "f", "v")
    if not keep_single:
        d = d.withColumn("v", F.when(F.size("v") >= 2, F.col("v")))
    # An inner explode would add a filter on the array, and the optimizer would
    # then compute the array again below every step that it takes.
    d = d.select("k", F.posexplode_outer("v").alias("p", "x")).where("p is not null")
    return d.select(F.col("k").alias(key), (F.col("p") + 1).cast("int").alias(pos), F.col("x").alias(value))
