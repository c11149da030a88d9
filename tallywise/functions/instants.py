"""Parsing of timestamps written in many forms, as Spark expressions."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Month names of the languages read, in calendar order; fixed values.
MONTHS = (
    "january february march april may june july august september october november december",
    "januar februar märz april mai juni juli august september oktober november dezember",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
)
#: Short forms that aren't the first three letters of a name above; fixed values.
SHORT_MONTHS = {"sept": 9, "mrz": 3, "maer": 3, "fevr": 2, "févr": 2, "janv": 1, "avr": 4, "juil": 7, "déc": 12, "ene": 1, "set": 9}
#: Years that a bare number may name.
EPOCH_YEARS = (2025, 2026)

_ZONE = r"(Z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Z]{2,5})?(?:\[([A-Za-z0-9_+/-]+)\])?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([AP]M))?"
_WORD = r"([\p{L}]{3,10})\.?"
_DAY = r"(?:[\p{L}]{2,10},? +)?"
#: Format name, pattern, and the groups of year, month, day, hour, minute, second, fraction, am/pm, zone, bracket.
FORMATS: tuple[tuple[str, str, str], ...] = (
    ("ymd", rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})[T ]{_TIME} ?{_ZONE}$", "1 2 3 4 5 6 7 8 9 10"),
    ("ymd_slash", rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})[T ]{_TIME} ?{_ZONE}$", "1 2 3 4 5 6 7 8 9 10"),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[T ](\d{{2}}):?(\d{{2}}):?(\d{{2}})(?:[.,](\d+))?() ?{_ZONE}$", "1 2 3 4 5 6 7 8 9 10"),
    ("numeric", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? {_TIME} ?{_ZONE}$", "3 1 2 4 5 6 7 8 9 10"),
    ("dotted", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? {_TIME} ?{_ZONE}$", "3 2 1 4 5 6 7 8 9 10"),
    ("day_month", rf"^{_DAY}(\d{{1,2}})\.? {_WORD} (\d{{4}}),? {_TIME} ?{_ZONE}$", "3 2 1 4 5 6 7 8 9 10"),
    ("month_day", rf"^{_DAY}{_WORD} (\d{{1,2}}),? (\d{{4}}),? {_TIME} ?{_ZONE}$", "3 1 2 4 5 6 7 8 9 10"),
    ("ordinal", rf"^(\d{{4}})-(\d{{3}})()[T ]{_TIME} ?{_ZONE}$", "1 2 3 4 5 6 7 8 9 10"),
    ("unix_date", rf"^{_DAY}{_WORD} +(\d{{1,2}}) {_TIME} {_ZONE} (\d{{4}})$", "10 1 2 3 4 5 6 7 8 9"),
)
_EPOCH = r"^\d{9,20}(?:\.\d*)?$"


def months() -> dict[str, int]:
    out = dict(SHORT_MONTHS)
    for line in MONTHS:
        for i, name in enumerate(line.split(), 1):
            out[name] = i
            out.setdefault(name[:3], i)
    return out


@cache
def _zone_rows(first: int = 2020, last: int = 2031) -> list[tuple[str, dict[str, int]]]:
    """Each IANA zone with its abbreviations that mean one offset, over those years."""
    rows = []
    for name in sorted(available_timezones()):
        z, found = ZoneInfo(name), {}
        for y in range(first, last):
            for m in (1, 4, 7, 10):
                t = datetime(y, m, 1, tzinfo=UTC).astimezone(z)
                found.setdefault(t.tzname().upper(), set()).add(int(t.utcoffset().total_seconds()))
        rows.append((name, {k: v.pop() for k, v in found.items() if len(v) == 1 and k.isalpha()}))
    return rows


def zones(spark: SparkSession) -> DataFrame:
    """(zone, abbreviations map<string,int seconds>): as many rows as there are IANA zones."""
    return spark.createDataFrame(_zone_rows(), "zone string, abbreviations map<string,int>")


def tidy(c: Column) -> Column:
    """Without surrounding white space and quotes."""
    x = F.regexp_replace(c, r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$", "")
    return F.regexp_replace(x, r"^([\"'])\s*(.*?)\s*\1$", "$2")


def canonical(c: Column) -> Column:
    """``format|year|month|day|hour|minute|second|fraction|am/pm|zone|bracket`` or ``epoch|number``; null if no format fits.

    One pattern matches, then one replacement runs; later formats aren't tried.
    """
    out = None
    for name, pattern, groups in FORMATS:
        p = "(?i)" + pattern
        to = name + "".join(f"|${g}" for g in groups.split())
        out = (F.when if out is None else out.when)(c.rlike(p), F.regexp_replace(c, p, to))
        if name == "ymd":  # epochs are the second most frequent
            out = out.when(c.rlike(_EPOCH), F.concat(F.lit("epoch|"), c))
    return out


def days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date (bigint), for valid dates."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    mm = (m + 9) % 12
    return yy * 365 + F.floor(yy / 4) - F.floor(yy / 100) + F.floor(yy / 400) + F.floor((mm * 306 + 5) / 10) + d - 1 - 719468


def month_length(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).when(m.between(1, 12), 31).otherwise(0)


def _epoch_spans() -> list[tuple[str, int, Column, Column]]:
    """(unit, digits to shift to the left, least and first too great number) of each unit in EPOCH_YEARS. The spans don't meet, so at most one unit fits."""
    low = int(datetime(EPOCH_YEARS[0], 1, 1, tzinfo=UTC).timestamp())
    high = int(datetime(EPOCH_YEARS[1] + 1, 1, 1, tzinfo=UTC).timestamp())
    return [(u, up, *(F.lit(str(x * 10**digits)).cast("decimal(20,0)") for x in (low, high))) for u, digits, up in (("s", 0, 6), ("ms", 3, 3), ("us", 6, 0), ("ns", 9, -3))]


def epoch_unit(number: Column) -> Column:
    """``epoch s``, ``epoch ms``, ``epoch us`` or ``epoch ns`` of a bare number, or null."""
    n = F.substring_index(number, ".", 1).try_cast("decimal(20,0)")
    out = None
    for unit, _, least, most in _epoch_spans():
        out = (F.when if out is None else out.when)((n >= least) & (n < most), F.lit(f"epoch {unit}"))
    return out


def epoch_micros(number: Column) -> Column:
    """Microseconds of a bare number, in the unit that puts it in EPOCH_YEARS; null in none. Exact: the digits are shifted, never made a double."""
    whole, frac = F.substring_index(number, ".", 1), F.when(F.contains(number, F.lit(".")), F.substring_index(number, ".", -1)).otherwise("")
    n = whole.try_cast("decimal(20,0)")
    out = None
    for _, up, least, most in _epoch_spans():
        if up > 0:
            v = F.concat(whole, F.substring(F.rpad(frac, up, "0"), 1, up)).try_cast("long")
        else:
            v = F.substring(whole, F.lit(1), F.length(whole) + up).try_cast("long")
        out = (F.when if out is None else out.when)((n >= least) & (n < most), v)
    return out
