"""Streaming counterparts: an incremental keep-max over deliveries, and windowed usage with late data.

The engine's reports are batch reports; these let them be kept up to date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def best_copies(stream: DataFrame, key: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The best copy of each message so far (update or complete mode); equals the batch keep-max of all input.

    Rows without a full key aren't deduplicated and don't belong in here. State is one
    row per key, merged map-side like any aggregate.
    """
    for k in key:
        stream = stream.where(F.col(k).isNotNull())
    rank = F.struct(F.coalesce(F.col(value), F.lit(0)).alias("v"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    return stream.groupBy(*key).agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("copies")).select(*key, F.col("best.v").alias(value), *[F.col(f"best.o{i}").alias(o) for i, o in enumerate(order)], "copies")


def usage_by_window(stream: DataFrame, ts: str = "record_timestamp", width: str = "1 hour", late: str = "2 days", by: Sequence[str] = ("model",), cols: Sequence[str] = ("input_tokens", "output_tokens")) -> DataFrame:
    """Sums by time window; records later than the watermark are left out."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *by)
    d = w.agg(F.count(F.lit(1)).alias("records"), *[F.sum(c).alias(c) for c in cols])
    return d.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "records", *cols)


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All input available now, into Parquet, exactly once."""
    return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
