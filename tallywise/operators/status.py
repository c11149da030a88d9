"""Pipeline B on rows: sessions, actions, windows and roll-ups of cumulative counters that start again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywise.operators.counters import MARK, ROW, scan
from tallywise.operators.records import holds, in_range
from tallywise.plans.ordered import Ordered
from tallywise.plans.scale import join_checked, materialise

#: Least rest of cost that the end flush books.
REST = 1e-9


@dataclass(frozen=True)
class Status:
    """Column names of status rows. ``seq`` is the position in the file."""

    session: str = "session_id"
    ts: str = "ts"
    seq: str = "snap_id"
    cost: str = "total_cost_usd"
    duration: str = "total_duration_ms"
    others: tuple[str, ...] = ("total_api_duration_ms", "total_lines_added", "total_lines_removed")
    project: str = "project_dir"
    model: str = "display_name"
    version: str = "client_version"
    context: str = "context_used_percentage"
    five_hour: str = "five_hour_used_percentage"
    five_hour_resets: str = "five_hour_resets_at"
    seven_day: str = "seven_day_used_percentage"
    seven_day_resets: str = "seven_day_resets_at"

    @property
    def counters(self) -> tuple[str, ...]:
        return (self.cost, self.duration, *self.others)


S = Status()


def percent(c: Column) -> Column:
    """Rounded half away from zero, within 0 and 255; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(255), F.round(F.greatest(F.lit(-1.0), F.least(F.lit(300.0), c))).cast("int"))))


def valid(df: DataFrame, s: Status = S, required: Sequence[str] = ()) -> DataFrame:
    """Rows with all required fields; optional counters 0 and optional texts empty; percentages rounded."""
    need = [s.session, s.ts, s.seq, s.cost, s.duration, *required]
    d = df
    for c in need:
        d = d.where(F.col(c).isNotNull())
    d = d.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in s.others})
    d = d.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in (s.project, s.model, s.version)})
    return d.withColumns({c: percent(F.col(c)) for c in (s.context, s.five_hour, s.seven_day)})


def rejected(df: DataFrame, s: Status = S) -> DataFrame:
    """One row (loaded, malformed)."""
    ok = F.lit(True)
    for c in (s.session, s.ts, s.seq, s.cost, s.duration):
        ok = ok & F.col(c).isNotNull()
    return df.agg(F.count_if(ok).alias("loaded"), F.count_if(~ok).alias("malformed"))


def select_status(
    df: DataFrame, first: str | None = None, last: str | None = None, tz: str = "UTC", session: str | None = None, project: str | None = None,
    model: str | None = None, s: Status = S,
) -> DataFrame:
    """User filters, before any aggregation; the model part may be in id or display name."""
    both = F.concat_ws(" ", F.coalesce(F.col("model_id"), F.lit("")), F.coalesce(F.col(s.model), F.lit("")))
    return df.where(in_range(F.timestamp_seconds(s.ts), first, last, tz) & holds(F.col(s.session), session) & holds(F.col(s.project), project) & holds(both, model))


def cumulative(df: DataFrame, s: Status = S) -> DataFrame:
    """Rows with ``segment`` from 1 and ``cum_<counter>``: the total up to the row, over all segments of its session so far.

    A segment begins where cost or duration fell from a row that had some.
    """
    return scan(df, s.session, [s.ts, s.seq], s.counters)


def sessions(df: DataFrame, s: Status = S) -> DataFrame:
    """One row per session: totals over segments less the first row's values (at least 0), first project, last model and version, extremes.

    Rows of equal ``ts`` are in order of ``seq``. Totals and segments never fall along
    a session, so those of its last row are its greatest; a session of any length is
    spread over tasks.
    """
    at = F.struct(s.ts, s.seq)
    j = cumulative(df, s).groupBy(s.session).agg(
        F.max("segment").alias("segments"), *[F.max(f"cum_{c}").alias(f"_t_{c}") for c in s.counters],
        F.min_by(F.struct(s.project, *s.counters), at).alias("_first"), F.max_by(F.struct(s.model, s.version), at).alias("_last"),
        F.max(s.context).alias("max_context_pct"), F.min(s.ts).alias("first_ts"), F.max(s.ts).alias("last_ts"),
        F.min(s.five_hour).alias("min_five_hour_pct"), F.max(s.five_hour).alias("max_five_hour_pct"),
        F.min(s.seven_day).alias("min_seven_day_pct"), F.max(s.seven_day).alias("max_seven_day_pct"),
    )
    return j.select(
        s.session, F.col(f"_first.{s.project}").alias("project"), F.col(f"_last.{s.model}").alias("model_name"), F.col(f"_last.{s.version}").alias("version"),
        "segments", *[F.greatest(F.col(f"_t_{c}") - F.col(f"_first.{c}"), F.lit(0)).alias(c) for c in s.counters],
        "max_context_pct", "first_ts", "last_ts", "min_five_hour_pct", "max_five_hour_pct", "min_seven_day_pct", "max_seven_day_pct",
    )


def _rollup(d: DataFrame, label: Column, name: str, s: Status = S) -> DataFrame:
    return d.groupBy(label.alias(name)).agg(
        F.count(F.lit(1)).alias("sessions"), *[F.sum(c).alias(c) for c in s.counters],
        F.min("min_five_hour_pct").alias("min_five_hour_pct"), F.max("max_five_hour_pct").alias("max_five_hour_pct"),
        F.min("min_seven_day_pct").alias("min_seven_day_pct"), F.max("max_seven_day_pct").alias("max_seven_day_pct"),
    )


def by_project(session_rows: DataFrame, s: Status = S) -> DataFrame:
    return _rollup(session_rows, F.col("project"), "project", s)


def by_day(session_rows: DataFrame, tz: str = "UTC", s: Status = S) -> DataFrame:
    """By the day of a session's first row; a session isn't split at midnight."""
    return _rollup(session_rows, F.date_format(F.from_utc_timestamp(F.timestamp_seconds("first_ts"), tz), "yyyy-MM-dd"), "day", s)


def totals(rows: DataFrame, s: Status = S) -> DataFrame:
    """The totals row of a view."""
    return _rollup(rows, F.lit("TOTAL"), "label", s)


def cumulative_cost(session_rows: DataFrame, s: Status = S, order: str | None = None) -> DataFrame:
    """(session, first_ts, cost, cumulative) in order of session id (or ``order``)."""
    o = Ordered(session_rows.select(s.session, "first_ts", s.cost), [], [order or s.session]).running(sums={"cumulative": F.col(s.cost)})
    return o.df


def actions(df: DataFrame, s: Status = S) -> DataFrame:
    """The rows at which the pair of percentages changes, in file order over all sessions, with the cost since the session's last such row.

    Rows need all four rate fields. The first change of a session counts from the
    session's first cost over all its rows; a cost below the one before counts as a
    whole. What a session spent after its last change is added to that row, or, if it
    has none, forms a row of its own (``flushed``) at its last qualifying record.
    """
    rate = [s.five_hour, s.five_hour_resets, s.seven_day, s.seven_day_resets]
    base = df.groupBy(s.session).agg(F.min_by(s.cost, s.seq).alias("_base"))
    q = df.select(s.session, s.ts, s.seq, s.cost, *rate)
    for c in rate:
        q = q.where(F.col(c).isNotNull())
    o = Ordered(q, [], [s.seq]).lag([s.five_hour, s.seven_day])
    fresh = ~(F.col(f"prev_{s.five_hour}").eqNullSafe(F.col(s.five_hour)) & F.col(f"prev_{s.seven_day}").eqNullSafe(F.col(s.seven_day)))
    hit = o.df.where(fresh).drop("_has_prev", f"prev_{s.five_hour}", f"prev_{s.seven_day}")
    last = q.groupBy(s.session).agg(F.max_by(F.struct(s.ts, s.seq, s.cost, *rate), s.seq).alias("_q"))
    h = Ordered(hit, [s.session], [s.seq]).lag([s.cost]).df
    end = h.groupBy(s.session).agg(F.max(s.seq).alias("_end"), F.max_by(s.cost, s.seq).alias("_shown"))
    per = materialise(last.join(base, s.session).join(end, s.session, "left"))
    spent = lambda now, was: F.when(now < was, now).otherwise(now - was)
    rest = spent(F.col("_q")[s.cost], F.coalesce("_shown", "_base"))
    per = per.withColumn("_rest", F.when(rest > REST, rest).otherwise(0.0))
    h = join_checked(h, per.select(s.session, "_base", "_end", "_rest"), [s.session])
    delta = spent(F.col(s.cost), F.coalesce(F.col(f"prev_{s.cost}"), F.col("_base"))) + F.when(F.col(s.seq) == F.col("_end"), F.col("_rest")).otherwise(0.0)
    shown = h.select(s.ts, s.seq, s.session, delta.alias("cost_delta"), *rate, F.lit(False).alias("flushed"))
    own = per.where("_end is null and _rest > 0")
    own = own.select(*[F.col("_q")[c].alias(c) for c in (s.ts, s.seq)], s.session, F.col("_rest").alias("cost_delta"), *[F.col("_q")[c].alias(c) for c in rate], F.lit(True).alias("flushed"))
    return shown.unionByName(own)


def overlap_ratio(start: Column, end: Column, intervals: Sequence[tuple[int, int]]) -> Column:
    """Share of the half-open [start, end) that the half-open intervals cover (they must not overlap); 0 for nothing."""
    if not intervals:
        return F.lit(0.0)
    both = sum((F.greatest(F.lit(0), F.least(end, F.lit(b)) - F.greatest(start, F.lit(a))) for a, b in intervals), F.lit(0))
    return F.when(end > start, both / (end - start)).otherwise(0.0)


def budget(cost: Column, delta: Column, ratio: Column) -> Column:
    """What 100 per cent would cost: null without a difference in percentage."""
    return F.when(delta > 0, cost * 100 / (F.when(delta > 0, delta).otherwise(1) * (1 + ratio)))


def windows(df: DataFrame, kind: str = "5h", intervals: Sequence[tuple[int, int]] = (), s: Status = S) -> DataFrame:
    """Windows that the data name by their end (``kind`` 5h, 1w, or 1h: the five hours of each 5h window).

    Percentages and the number of sessions come from the window's own rows; what was
    spent is, for each of those sessions, its total before the end less its total
    before the start, over all its rows; before its first row a session has that
    row's values. Rows without the end belong to no window, and rows outside a 5h
    window's time to no hour of it. A missing 5h percentage is 0.

    The boundaries are put in order among the rows of their session, so that one scan
    gives every total; rows aren't multiplied by windows.
    """
    if kind not in ("1h", "5h", "1w"):
        raise ValueError(kind)
    resets = s.seven_day_resets if kind == "1w" else s.five_hour_resets
    length = {"1h": 18_000, "5h": 18_000, "1w": 604_800}[kind]
    base = df.groupBy(s.session).agg(F.min_by(F.struct(*s.counters), F.struct(s.ts, s.seq)).alias("_base"))
    w = df.where(F.col(resets).isNotNull()).withColumn("window_end", F.col(resets)).withColumn("window_start", F.col(resets) - length)
    if kind == "1h":
        hour = F.floor((F.col(s.ts) - F.col("window_start")) / 3600)
        w = w.where((hour >= 0) & (hour < 5)).withColumn("window_start", F.col("window_start") + hour * 3600).withColumn("window_end", F.col("window_start") + 3600)
    who = ["window_start", "window_end", resets]
    pct = w.groupBy(*who).agg(
        F.coalesce(F.min(s.five_hour), F.lit(0)).alias("min_five_hour_pct"), F.coalesce(F.max(s.five_hour), F.lit(0)).alias("max_five_hour_pct"),
        F.min(s.seven_day).alias("min_seven_day_pct"), F.max(s.seven_day).alias("max_seven_day_pct"),
    )
    pairs = materialise(w.select(*who, s.session).distinct())
    marks = pairs.select(s.session, F.explode(F.array("window_start", "window_end")).alias(s.ts)).distinct()
    none = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in (s.seq, *s.counters)]
    rows = df.select(s.session, F.col(s.ts).cast("long").alias(s.ts), s.seq, *s.counters, F.lit(ROW).alias("_row"))
    stream = rows.unionByName(marks.select(s.session, F.col(s.ts).cast("long").alias(s.ts), *none, F.lit(MARK).alias("_row")))
    at = scan(stream, s.session, [s.ts, "_row", s.seq], s.counters, "_row").where(F.col("_row") == MARK).withColumnRenamed(s.ts, "_t")
    at = join_checked(at, base, [s.session]).select(s.session, "_t", F.struct(*[F.coalesce(f"cum_{c}", F.col("_base")[c]).alias(c) for c in s.counters]).alias("_v"))
    at = materialise(at)
    d = pairs.join(at.select(s.session, F.col("_t").alias("window_end"), F.col("_v").alias("_e")), [s.session, "window_end"])
    d = d.join(at.select(s.session, F.col("_t").alias("window_start"), F.col("_v").alias("_s")), [s.session, "window_start"])
    d = d.groupBy(*who).agg(
        F.count(F.lit(1)).alias("sessions"), *[F.sum(F.greatest(F.col("_e")[c] - F.col("_s")[c], F.lit(0))).alias(c) for c in s.counters]
    )
    d = d.join(pct, who)
    hi, lo = ("max_seven_day_pct", "min_seven_day_pct") if kind == "1w" else ("max_five_hour_pct", "min_five_hour_pct")
    delta = F.coalesce(F.col(hi), F.lit(0)) - F.coalesce(F.col(lo), F.lit(0))
    d = d.withColumn("est_budget", budget(F.col(s.cost), delta, overlap_ratio(F.col("window_start"), F.col("window_end"), intervals)))
    return d.withColumnRenamed(resets, "resets_at")


def windows_in_range(w: DataFrame, first: str | None = None, last: str | None = None, tz: str = "UTC") -> DataFrame:
    """Windows that end after ``first`` and start before ``last``; text comparison of wall times, bounds of 16 characters get seconds."""
    text = lambda c: F.date_format(F.from_utc_timestamp(F.timestamp_seconds(c), tz), "yyyy-MM-dd'T'HH:mm:ss")
    full = lambda b: (b.replace(" ", "T") + ":00") if len(b) == 16 else b.replace(" ", "T")
    if first:
        w = w.where(text("window_end") > full(first))
    if last:
        w = w.where(text("window_start") < full(last))
    return w
