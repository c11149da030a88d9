"""One- and two-level breakdowns with subtotals, and series for charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")
COSTS = ("input_cost", "output_cost", "cache_creation_cost", "cache_read_cost", "total_cost")
DIMENSIONS = ("day", "hour", "month", "session", "project", "model", "subagent", "tool", "line")
#: Levels of a breakdown by grouping id.
CHILD, PARENT, TOTAL_CHILD, TOTAL = 0, 1, 2, 3


def short_model(c: Column, prefix: str = "claude-") -> Column:
    """Without vendor prefix and trailing date; variants of a model merge."""
    return F.regexp_replace(F.regexp_replace(c, f"^{prefix}", ""), r"-\d{8}$", "")


def key(dimension: str, tz: str = "UTC", ts: str = "record_timestamp") -> Column:
    """The label of a record under a dimension."""
    t = F.from_utc_timestamp(F.col(ts), tz)
    keys = {
        "day": lambda: F.date_format(t, "yyyy-MM-dd"),
        "hour": lambda: F.date_format(t, "yyyy-MM-dd HH:00"),
        "month": lambda: F.date_format(t, "yyyy-MM"),
        "session": lambda: F.col("session_id"),
        "project": lambda: F.col("project"),
        "model": lambda: short_model(F.col("model")),
        "subagent": lambda: F.when(F.col("agent_id") == "", "(main)").otherwise(F.col("agent_id")),
        "tool": lambda: F.when(F.col("tool_names") == "", "(text)").otherwise(F.col("tool_names")),
        "line": lambda: F.concat(F.lit("#"), F.col("line_no").cast("string")),
    }
    return keys[dimension]()


def sums(df: DataFrame, cols: Sequence[str] | None = None) -> list[Column]:
    return [F.sum(c).alias(c) for c in (cols or [c for c in (*COUNTERS, *COSTS) if c in df.columns])]


def breakdown(df: DataFrame, dimensions: Sequence[str], tz: str = "UTC", ts: str = "record_timestamp", cols: Sequence[str] | None = None) -> DataFrame:
    """(level, parent, child, sums...) for one or two dimensions, also the same one twice.

    With two: each pair (CHILD), each value of the first (PARENT), of the second
    over all (TOTAL_CHILD), and TOTAL. With one, PARENT and TOTAL. Null labels are
    labels. An empty input, or no dimension, gives a TOTAL of zeros.
    """
    if len(dimensions) > 2:
        raise ValueError("at most two dimensions")
    use = list(cols or [c for c in (*COUNTERS, *COSTS) if c in df.columns])
    d = df.select(*[key(x, tz, ts).alias(f"_d{i}") for i, x in enumerate(dimensions)], *use)
    null = F.lit(None).cast("string")
    total = df.agg(*[F.coalesce(F.sum(c), F.lit(0).cast(df.schema[c].dataType)).alias(c) for c in use]).select(
        F.lit(TOTAL).alias("level"), null.alias("parent"), null.alias("child"), *use
    )
    if not dimensions:
        return total
    agg = [F.sum(c).alias(c) for c in use]
    if len(dimensions) == 1:
        return d.groupBy("_d0").agg(*agg).select(F.lit(PARENT).alias("level"), F.col("_d0").alias("parent"), null.alias("child"), *use).unionByName(total)
    cube = d.cube("_d0", "_d1").agg(F.grouping_id().cast("int").alias("level"), *agg).where(F.col("level") != TOTAL)
    return cube.select("level", F.col("_d0").alias("parent"), F.col("_d1").alias("child"), *use).unionByName(total)


def in_order(df: DataFrame, descending: bool = False) -> DataFrame:
    """Sorted by label at each level, ``#N`` labels by number, totals last."""
    number = lambda c: F.regexp_extract(F.coalesce(F.col(c), F.lit("")), r"^#(\d+)", 1).try_cast("int")
    way = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    last = F.col("level").isin(TOTAL, TOTAL_CHILD).cast("int")
    main = F.col("level").isin(CHILD, TOTAL_CHILD).cast("int")
    return df.orderBy(last, way(number("parent")), way(F.col("parent")), main, way(number("child")), way(F.col("child")))


def with_display(df: DataFrame) -> DataFrame:
    """All input tokens, and all tokens."""
    inn = F.col("input_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")
    return df.withColumns({"all_input": inn, "all_tokens": inn + F.col("output_tokens")})


def granularity(first, last, records: int) -> str:
    """day for fewer than 2 records; hour up to 2 days; day up to 90; month beyond."""
    if records < 2 or first is None:
        return "day"
    span = (last - first).total_seconds()
    return "hour" if span <= 2 * 86_400 else "day" if span <= 90 * 86_400 else "month"


def series(df: DataFrame, value: Column, ts: str = "record_timestamp", tz: str = "UTC") -> DataFrame:
    """(label, value): sums by hour, day or month, as the span of the records asks."""
    first, last, n = df.where(F.col(ts).isNotNull()).agg(F.min(ts), F.max(ts), F.count(F.lit(1))).first()
    g = granularity(first, last, n)
    return df.where(F.col(ts).isNotNull()).groupBy(key(g, tz, ts).alias("label")).agg(F.sum(value).alias("value"))
