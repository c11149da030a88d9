"""Mixed timestamp formats and zones, normalised to one UTC instant.

Every value is parsed under each format that fits, which gives it readings: month or
day first, a unit of an epoch, the first or second of a repeated wall time. Per
source, expectation-maximisation over the mixture of formats weighs them. What is
registered of a source makes readings against it unlikely, not impossible; that a value
is none of its formats is a component too. The posterior chooses, and what stays
undecided is marked so.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywise.functions.instants import canonical, days, epoch_micros, epoch_unit, month_length, months, tidy, zones
from tallywise.plans.scale import join_checked, materialise, small_methods

#: A posterior from which a reading is chosen.
SURE = 0.95
#: Likelihoods of a value under a format that the registered order speaks against, and under none of the formats.
AGAINST, NONE = 1e-6, 1e-4
#: Counts that every component has beforehand: two clear values decide for a source's unclear ones, one doesn't.
BEFORE = 0.1
#: Most steps of the expectation-maximisation and the change at which it ends.
STEPS, CLOSE = 5_000, 1e-10
_DAY_S = 86_400
_READINGS = "array<struct<format:string,micros:bigint,status:string>>"


def _wall(part, y: Column, m: Column, d: Column) -> Column:
    """Microseconds of the wall time as if it were UTC; null if impossible."""
    h0, mi, s = part(4).cast("int"), part(5).cast("int"), F.coalesce(F.when(part(6) != "", part(6).cast("int")), F.lit(0))
    ap = F.upper(part(8))
    h = F.when(ap == "", h0).when(h0.between(1, 12), h0 % 12 + F.when(ap == "PM", 12).otherwise(0))
    micros = F.substring(F.rpad(part(7), 6, "0"), 1, 6).cast("long")
    ok = (m >= 1) & (m <= 12) & (d >= 1) & (d <= month_length(y, m)) & (h <= 23) & (mi <= 59) & (s <= 59)
    secs = days(y, m, d).cast("long") * _DAY_S + h * 3600 + mi * 60 + s
    return F.when(ok, secs * 1_000_000 + micros)


def _offset(part) -> Column:
    """Seconds east of UTC that the value itself names; null if it names none or an unknown one."""
    z = F.upper(part(9))
    digits = F.regexp_replace(F.substring(z, 2, 5), ":", "")
    secs = F.substring(digits, 1, 2).cast("int") * 3600 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)) * 60
    return F.when(z.isin("Z", "UTC", "GMT"), F.lit(0)).when(z.rlike(r"^[+-]\d"), F.when(z.startswith("-"), -secs).otherwise(secs)).otherwise(F.try_element_at("_abbreviations", z))


def _utc(wall: str, zone: str) -> Column:
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), F.col(zone)))


def _local(utc: Column, zone: str) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc), F.col(zone)))


def readings(values: DataFrame, sources: DataFrame) -> DataFrame:
    """(row, field, source, readings, signature): the readings of each value that fits a format.

    ``values`` has row, field, source, text; ``sources`` has source, zone, order.
    Readings are an array of (format, micros, status); ``status`` is instant, skipped
    (a wall time that a zone jumps over), repeated (one it has twice: two readings) or
    unknown_zone; impossible ones aren't there. The signature lists the formats, with
    ``!`` where the registered order speaks against one. Values that fit no format
    give no row.
    """
    spark = values.sparkSession
    z = zones(spark)
    src = sources.select(F.col("source"), F.col("zone").alias("_zone"), F.lower("order").alias("_order")).dropDuplicates(["source"])
    src = src.withColumn("_zone", F.coalesce(F.when(F.trim("_zone") != "", F.trim("_zone")), F.lit("UTC")))
    src = src.join(F.broadcast(z.withColumnRenamed("zone", "_zone")), "_zone", "left")
    fixed = F.col("_zone").rlike(r"^[+-]\d{2}:\d{2}$")
    src = src.withColumn("_known", fixed | F.col("abbreviations").isNotNull()).withColumnRenamed("abbreviations", "_abbreviations")
    d = values.withColumn("_c", canonical(tidy(F.col("text")))).where("_c is not null").drop("text")
    d = join_checked(d, src, ["source"])
    d = d.withColumn("_zone", F.coalesce("_zone", F.lit("UTC"))).withColumn("_known", F.coalesce("_known", F.lit(True)))
    d = d.withColumn("_p", F.split("_c", r"\|", -1)).drop("_c")
    part = lambda i: F.get(F.col("_p"), F.lit(i))
    kind = part(0)
    names = F.create_map(*[F.lit(x) for kv in months().items() for x in kv])
    y = part(1).try_cast("int")
    named = kind.isin("day_month", "month_day", "unix_date")
    m0 = F.when(named, F.try_element_at(names, F.lower(part(2)))).when(kind == "ordinal", F.lit(1)).otherwise(part(2).try_cast("int"))
    d0 = F.when(kind == "ordinal", F.lit(1)).otherwise(part(3).try_cast("int"))
    d = d.withColumns({"_y": y, "_m": m0, "_d": d0})
    yy, mm, dd = F.col("_y"), F.col("_m"), F.col("_d")
    # An ordinal day is 1 January plus its days, if the year has that many.
    nth = part(2).try_cast("int")
    length = F.when(month_length(yy, F.lit(2)) == 29, 366).otherwise(365)
    shift = F.when(kind == "ordinal", F.when(nth.between(1, length), (nth - 1).cast("long") * _DAY_S * 1_000_000)).otherwise(F.lit(0))
    clock = kind != "epoch"
    d = d.withColumns(
        {
            "_wa": F.when(clock, _wall(part, yy, mm, dd) + shift),
            "_wb": F.when(kind == "numeric", _wall(part, yy, dd, mm)),
            "_off": F.when(clock & (part(9) != ""), _offset(part)),
            "_says": clock & (part(9) != ""),
            "_own": F.when(part(10) != "", part(10)),
            "_fmt": kind,
            "_num": F.when(~clock, epoch_micros(part(1))),
            "_fmt_unit": F.when(~clock, epoch_unit(part(1))),
        }
    ).drop("_p", "_y", "_m", "_d", "_abbreviations")
    # A zone in brackets counts where no offset is written.
    d = d.join(F.broadcast(z.select(F.col("zone").alias("_own"), F.lit(True).alias("_own_ok"))), "_own", "left")
    d = d.withColumn("_z", F.when(F.col("_own").isNull(), F.col("_zone")).when(F.col("_own_ok"), F.col("_own")))
    d = d.withColumn("_z_ok", F.when(F.col("_own").isNull(), F.col("_known")).otherwise(F.coalesce("_own_ok", F.lit(False))))
    d = d.withColumn("_z", F.when(F.col("_z_ok"), F.col("_z")).otherwise(F.lit("UTC")))
    local = ~F.col("_says") & (F.col("_z") != "UTC")
    d = d.withColumns({f"_u{k}": F.when(local, _utc(f"_w{k}", "_z")) for k in "ab"})

    # to_utc_timestamp() takes one of the two instants of a repeated wall time; the other is off by the length of the jump.
    for k in "ab":
        w, u, other = F.col(f"_w{k}"), F.col(f"_u{k}"), None
        for minutes in (60, 30, 120):
            for v in (u + minutes * 60_000_000, u - minutes * 60_000_000):
                other = (F.when if other is None else other.when)(_local(v, "_z") == w, v)
        d = d.withColumn(f"_o{k}", F.when(u.isNotNull(), other))

    def reading(k: str) -> Column:
        w, u, o = F.col(f"_w{k}"), F.col(f"_u{k}"), F.col(f"_o{k}")
        fmt = F.when(F.col("_fmt") == "numeric", F.lit("mdy" if k == "a" else "dmy")).otherwise(F.col("_fmt"))
        one = lambda micros, status, end="": F.struct(F.concat(fmt, F.lit(end)).alias("format"), micros.alias("micros"), F.lit(status).alias("status"))
        return (
            F.when(w.isNull(), F.array().cast(_READINGS))
            .when(F.col("_says") & F.col("_off").isNotNull(), F.array(one(w - F.col("_off").cast("long") * 1_000_000, "instant")))
            .when(F.col("_says") | ~F.col("_z_ok"), F.array(one(w, "unknown_zone")))
            .when(u.isNull(), F.array(one(w, "instant")))
            .when(_local(u, "_z") != w, F.array(one(u, "skipped")))
            .when(o.isNotNull(), F.array(one(F.least(u, o), "repeated", " first"), one(F.greatest(u, o), "repeated", " second")))
            .otherwise(F.array(one(u, "instant")))
        )

    epoch = F.when(F.col("_num").isNotNull(), F.array(F.struct(F.col("_fmt_unit").alias("format"), F.col("_num").alias("micros"), F.lit("instant").alias("status")))).otherwise(F.array().cast(_READINGS))
    both = F.when(F.col("_fmt") == "numeric", F.concat(reading("a"), reading("b"))).otherwise(reading("a"))
    d = d.withColumn("readings", F.when(F.col("_fmt") == "epoch", epoch).otherwise(both))
    order = F.coalesce("_order", F.lit(""))
    against = lambda r: order.isin("mdy", "dmy") & F.substring(r["format"], 1, 3).isin("mdy", "dmy") & (F.substring(r["format"], 1, 3) != order)
    sign = F.array_join(F.transform("readings", lambda r: F.concat(r["format"], F.when(against(r), "!").otherwise(""))), ",")
    return d.select("row", "field", "source", "readings", sign.alias("signature"))


def _step(pi: np.ndarray, like: np.ndarray, n: np.ndarray) -> np.ndarray:
    r = like * pi
    r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
    new = (n[:, None] * r).sum(0) + BEFORE
    return new / new.sum()


def mixture(counts: pd.DataFrame, steps: int = STEPS) -> pd.DataFrame:
    """EM of one source: rows (source, signature, n) to (source, signature, format, posterior, converged).

    A value has likelihood 1 under each format of its signature, AGAINST where the
    registered order speaks against it, and NONE under the component of no format
    (``format`` null). Steps are extrapolated where they shrink evenly, so that a few
    clear values decide for any number of unclear ones; ``converged`` is false if
    STEPS weren't enough.
    """
    sigs = [s.split(",") if s else [] for s in counts["signature"]]
    names = sorted({f.rstrip("!") for s in sigs for f in s})
    like = np.full((len(sigs), len(names) + 1), 0.0)
    like[:, -1] = NONE
    for i, s in enumerate(sigs):
        for f in s:
            like[i, names.index(f.rstrip("!"))] = AGAINST if f.endswith("!") else 1.0
    n = counts["n"].to_numpy(dtype=float)
    pi, done = np.full(len(names) + 1, 1 / (len(names) + 1)), False
    for _ in range(steps):
        one = _step(pi, like, n)
        two = _step(one, like, n)
        done = bool(np.abs(two - one).max() < CLOSE)
        d1, d2 = one - pi, (two - one) - (one - pi)
        far = two
        if not done and (d2 @ d2) > 0:
            a = -np.sqrt((d1 @ d1) / (d2 @ d2))
            far = pi - 2 * min(a, -1.0) * d1 + min(a, -1.0) ** 2 * d2
        pi = far / far.sum() if (far > 0).all() else two
        if done:
            break
    r = like * pi
    r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
    best = r.argmax(1)
    return pd.DataFrame(
        {
            "source": counts["source"].to_numpy(),
            "signature": counts["signature"].to_numpy(),
            "format": [names[b] if b < len(names) else None for b in best],
            "posterior": r[np.arange(len(best)), best],
            "converged": done,
        }
    )


def normalise(
    df: DataFrame, row: str, fields: Sequence[str], source: str, sources: DataFrame, source_key: str, zone: str, order: str, sure: float = SURE
) -> DataFrame:
    """(row, field_name, instant_us, format, posterior, converged, status), one row per value that fits a format.

    ``status`` is ``instant`` where the value names exactly one instant; otherwise
    skipped, repeated, impossible (likely no time at all), unknown_zone or ambiguous
    (no reading reaches ``sure``), and ``instant_us`` is null. Null, empty and
    unreadable values, and those of only a date or a time of day, give no row. A source
    without zone is taken as UTC, one that isn't registered too; without a registered
    order its other values decide. Rows may repeat; each is read by itself.

    Parsed values are written once; their counts by source and signature, which
    are few, give the mixtures.
    """
    long = df.select(F.col(row).alias("row"), F.col(source).alias("source"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x"))
    long = long.select("row", "source", "x.*").where("text is not null")
    reg = sources.select(F.col(source_key).alias("source"), F.col(zone).alias("zone"), F.col(order).alias("order"))
    with small_methods(df.sparkSession):
        d = materialise(readings(long, reg))
    counts = d.groupBy("source", "signature").agg(F.count(F.lit(1)).alias("n"))
    picked = counts.groupBy("source").applyInPandas(lambda c: mixture(c), "source string, signature string, format string, posterior double, converged boolean")
    # Null sources are one source of their own.
    null = "\u0000"
    d = d.withColumn("source", F.coalesce("source", F.lit(null)))
    picked = materialise(picked.withColumn("source", F.coalesce("source", F.lit(null))))
    d = join_checked(d, picked, ["source", "signature"])
    d = d.withColumn("_r", F.try_element_at(F.filter("readings", lambda r: r["format"] == F.col("format")), F.lit(1)))
    sure_enough = (F.col("posterior") >= sure) | (F.col("_r.status") == "repeated")
    d = d.withColumn("status", F.when(F.col("_r").isNull(), "impossible").when(sure_enough, F.col("_r.status")).otherwise("ambiguous"))
    return d.select(
        F.col("row").alias(row),
        F.col("field").alias("field_name"),
        F.when(F.col("status") == "instant", F.col("_r.micros")).alias("instant_us"),
        "format",
        "posterior",
        "converged",
        "status",
    )
