"""User options: time zones, ranges, validation."""

from __future__ import annotations

import re
import time
from collections.abc import Mapping
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo, available_timezones

from tallywise.operators.grouping import DIMENSIONS

VIEWS = ("action", "session", "project", "day", "1h", "5h", "1w")
FORMATS = ("json", "markdown", "html", "txt", "csv", "tsv")
EXTENSIONS = {"json": "json", "markdown": "md", "html": "html", "txt": "txt", "csv": "csv", "tsv": "tsv"}
#: The shape of a date; a fixed pattern.
_DATE = re.compile(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?$")
#: Option -> its values; fixed values.
CHOICES = {"order": ("asc", "desc"), "table": ("auto", "full", "compact"), "cost": ("true", "false", "decimal"), "copy": FORMATS, "output": FORMATS}
CHARTS = {False: ("cost", "token"), True: ("5h", "1w", "cost")}
#: Shortcut -> (days and hours before, after); in the order of precedence.
SHORTCUTS = {"5hfrom": (0, 5), "5hto": (5, 0), "1wfrom": (0, 168), "1wto": (168, 0)}


def local_zone() -> str:
    name = getattr(datetime.now().astimezone().tzinfo, "key", None)
    if name:
        return name
    s = -time.timezone
    return f"{'-' if s < 0 else '+'}{abs(s) // 3600:02d}:{abs(s) % 3600 // 60:02d}"


def zone(tz: str | None) -> str:
    """A zone that Spark takes: UTC, ``+HH:MM`` or an IANA name; anything else is the local zone."""
    if not tz or tz.lower() == "local":
        return local_zone()
    if tz.upper() == "UTC":
        return "UTC"
    m = re.fullmatch(r"([+-])(\d{1,2}):(\d{2})", tz)
    if m:
        return f"{m[1]}{int(m[2]):02d}:{m[3]}"
    return tz if tz in available_timezones() else local_zone()


def python_zone(tz: str) -> ZoneInfo | object:
    """The zone of :func:`zone` for driver-side formatting."""
    from datetime import timezone

    m = re.fullmatch(r"([+-])(\d{2}):(\d{2})", tz)
    if m:
        d = timedelta(hours=int(m[2]), minutes=int(m[3]))
        return timezone(d if m[1] == "+" else -d)
    return ZoneInfo(tz)


def parse_moment(text: str) -> datetime | None:
    """10, 16 or 19 characters; None if it isn't a time."""
    x = text.replace(" ", "T")
    form = {10: "%Y-%m-%d", 16: "%Y-%m-%dT%H:%M", 19: "%Y-%m-%dT%H:%M:%S"}.get(len(x))
    try:
        return datetime.strptime(x, form) if form else None
    except ValueError:
        return None


def date_range(first: str | None = None, last: str | None = None, shortcuts: Mapping[str, str | None] | None = None) -> tuple[str | None, str | None]:
    """Bounds from a shortcut if one parses, else those given. Wall times, no daylight saving."""
    for name, (before, after) in SHORTCUTS.items():
        t = parse_moment(x) if shortcuts and (x := shortcuts.get(name)) else None
        if t:
            return tuple((t + timedelta(hours=h)).strftime("%Y-%m-%dT%H:%M:%S") for h in (-before, after))
    return first, last


def errors(o: Mapping[str, object], status: bool = False) -> list[str]:
    """All that is wrong with the options."""
    out = []
    per = list(o.get("per") or [])
    known = VIEWS if status else DIMENSIONS
    out += [f"unknown --per {p!r}; one of {', '.join(known)}" for p in per if p not in known]
    if len(per) > (1 if status else 2):
        out.append(f"at most {1 if status else 2} --per")
    dates = ("from", "to", *SHORTCUTS)
    out += [f"--{k} {o[k]!r} is no date" for k in dates if o.get(k) and not _DATE.match(str(o[k]))]
    five, week = [k for k in ("5hfrom", "5hto") if o.get(k)], [k for k in ("1wfrom", "1wto") if o.get(k)]
    for pair in (five, week):
        if len(pair) == 2:
            out.append(f"--{pair[0]} and --{pair[1]} exclude each other")
    if five and week:
        out.append("5h and 1w ranges exclude each other")
    if (five or week) and (o.get("from") or o.get("to")):
        out.append("a 5h or 1w range excludes --from and --to")
    for k, known in {**CHOICES, "chart": CHARTS[status]}.items():
        if o.get(k) and o[k] not in known:
            out.append(f"--{k}: invalid value {o[k]!r}. Valid: {', '.join(known)}")
    if o.get("chart") and o.get("output") not in (None, "txt"):
        out.append("--chart needs --output txt")
    if o.get("live_pricing") and o.get("pricing_data"):
        out.append("--live-pricing and --pricing-data exclude each other")
    if o.get("live_pricing") and not (o.get("pricing_url") and o.get("provider")):
        out.append("--live-pricing needs --pricing-url and at least one --provider; without prices all costs would be 0")
    if status and o.get("cost_diff") and per != ["session"]:
        out.append("--cost-diff needs --per session")
    return out
