"""Pipeline A on rows: predicates, keep-max deduplication, timestamp repair, filters, metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywise.plans.ordered import Ordered

#: Record types that hold usage; fixed values.
USAGE_TYPES = ("message", "user", "assistant")
SYNTHETIC = "<synthetic>"


def usable(df: DataFrame, type_: str = "record_type", model: str = "model", required: Sequence[str] = ("input_tokens", "output_tokens")) -> DataFrame:
    """Rows of a usage type (or none), with all required counters and a model that isn't synthetic; an empty model passes."""
    ok = (F.col(type_).isNull() | F.col(type_).isin(*USAGE_TYPES)) & F.col(model).isNotNull() & (F.col(model) != SYNTHETIC)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return df.where(ok)


def keep_max(df: DataFrame, key: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Of rows with the same key, the one with the greatest ``value`` (null counts as 0), ties by greatest ``order``.

    Rows with a null in the key pass through; keys match exactly. ``order`` should
    be unique; of rows equal in all of it one stays. Aggregation is partial before
    its shuffle, so a hot key is no group in one task.
    """
    keyed = F.lit(True)
    for k in key:
        keyed = keyed & F.col(k).isNotNull()
    rank = F.struct(F.coalesce(F.col(value), F.lit(0)).alias("_v"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.where(keyed).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.max_by(whole, rank).alias("_row"))
    return best.select("_row.*").unionByName(df.where(~keyed))


def dedup_counts(df: DataFrame, key: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """One row (before, after)."""
    one = lambda d, b, a: d.select(F.lit(b).alias("b"), F.lit(a).alias("a"))
    both = one(df, 1, 0).unionByName(one(keep_max(df, key, value, order), 0, 1))
    return both.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("before"), F.coalesce(F.sum("a"), F.lit(0)).alias("after"))


def parse_iso(c: Column) -> Column:
    """An ISO string with date and time, with a zone or in UTC, as timestamp; null otherwise."""
    s = F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"), F.try_to_timestamp(s))


def parse_number(c: Column) -> Column:
    """A number of seconds, or of milliseconds if over 1e12, as timestamp; null otherwise."""
    s = F.regexp_replace(c, r"^\s+|\s+$", "")
    x = F.when(s.rlike(r"^[+-]?\d{1,18}(\.\d+)?$"), s.cast("double"))
    seconds = F.when(x > 1e12, x / 1000).otherwise(x)
    return F.when(F.abs(seconds) < 2.5e11, F.timestamp_micros(F.round(seconds * 1e6).cast("long")))


def parse_time(c: Column) -> Column:
    """:func:`parse_iso`, else :func:`parse_number`."""
    return F.coalesce(parse_iso(c), parse_number(c))


def first_time(cols: Sequence[str]) -> Column:
    """The first column that parses."""
    return F.coalesce(*[parse_time(F.col(c)) for c in cols])


def repair_times(df: DataFrame, file: str, line: Sequence[str], ts: str, fallback: str) -> DataFrame:
    """Rows before a file's first timestamp take ``fallback``; later rows without one are dropped.

    A file without any takes ``fallback`` throughout. Files may be of any size.
    """
    o = Ordered(df, [file], line).running(maxes={"_seen": F.col(ts).isNotNull().cast("int")})
    d = o.df.withColumn(ts, F.coalesce(F.col(ts), F.when(F.col("_seen") == 0, F.col(fallback))))
    return d.where(F.col(ts).isNotNull()).drop("_seen")


def wall_text(ts: Column, tz: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, tz), "yyyy-MM-dd'T'HH:mm:ss")


def in_range(ts: Column, first: str | None = None, last: str | None = None, tz: str = "UTC") -> Column:
    """Text comparison of the wall time in ``tz``; a bound of 10 characters compares dates. Both ends belong."""
    text, ok = wall_text(ts, tz), F.lit(True)
    for bound, low in ((first, True), (last, False)):
        if bound:
            b = bound.replace(" ", "T")
            x = F.substring(text, 1, 10) if len(b) == 10 else text
            ok = ok & ((x >= b) if low else (x <= b))
    return ok


def holds(c: Column, part: str | None) -> Column:
    """Case-insensitive substring; no part holds always."""
    return F.contains(F.lower(c), F.lit(part.lower())) if part else F.lit(True)


def select_records(
    df: DataFrame, ts: str = "record_timestamp", first: str | None = None, last: str | None = None, tz: str = "UTC",
    project: str | None = None, model: str | None = None, session: str | None = None,
) -> DataFrame:
    """User filters; to be applied after deduplication and repair."""
    return df.where(
        in_range(F.col(ts), first, last, tz) & holds(F.col("project"), project) & holds(F.col("model"), model) & holds(F.col("session_id"), session)
    )


def zero_fill(df: DataFrame, cols: Sequence[str] = ("cache_creation_tokens", "cache_read_tokens")) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in cols})


def metadata(df: DataFrame, ts: str = "record_timestamp") -> DataFrame:
    """One row: earliest, latest, and numbers of different projects, models and sessions.

    The names themselves are :func:`names`, a table, since there may be many.
    """
    return df.agg(
        F.min(ts).alias("earliest"), F.max(ts).alias("latest"),
        *[F.countDistinct(c).alias(n) for c, n in (("project", "projects"), ("model", "models"), ("session_id", "sessions"))],
    )


def names(df: DataFrame) -> DataFrame:
    """(kind, name): different projects, models and sessions."""
    one = [F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in (("project", "project"), ("model", "model"), ("session", "session_id"))]
    return df.select(F.explode(F.array(*one)).alias("x")).select("x.*").where("name is not null").distinct()


def project_of(path: Column) -> Column:
    """The component after the first ``projects``; encoded names (leading ``-``) get slashes; else unknown."""
    p = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"(?:^|/)projects/([^/]+)", 1)
    return F.when(p == "", F.lit("unknown")).when(p.startswith("-"), F.replace(p, F.lit("-"), F.lit("/"))).otherwise(p)


def session_agent_of(path: Column) -> Column:
    """struct(session_id, agent_id) of a transcript path, old and new layout of sub-agents."""
    bits = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    stem = F.regexp_replace(F.element_at(bits, -1), r"\.[^.]*$", "")
    parent, grand = F.try_element_at(bits, F.lit(-2)), F.try_element_at(bits, F.lit(-3))
    uuid = (F.length(grand) == 36) & (F.length(grand) - F.length(F.replace(grand, F.lit("-"), F.lit(""))) == 4)
    sub = F.coalesce(parent == "subagents", F.lit(False))
    return F.struct(
        F.when(sub & F.coalesce(uuid, F.lit(False)), grand).otherwise(stem).alias("session_id"), F.when(sub, stem).otherwise("").alias("agent_id")
    )


def tool_combination(tools: Column) -> Column:
    """An array of names sorted, without repeats, joined by a comma and blank."""
    return F.array_join(F.array_sort(F.array_distinct(tools)), ", ")
