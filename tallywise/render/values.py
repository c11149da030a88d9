"""Display forms of single values."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

DASH = "—"


def tokens(n: float | None) -> str:
    """Millions with two decimals, thousands with one, else the number."""
    n = n or 0
    return f"{n / 1e6:.2f}M" if n >= 1_000_000 else f"{n / 1e3:.1f}K" if n >= 1_000 else str(int(n))


def whole(x: float) -> int:
    """Rounded half away from zero."""
    return int(Decimal(x).quantize(Decimal(1), ROUND_HALF_UP))


def cost(x: float | None, mode: str = "integer") -> str:
    """``$N``, ``$N.NN`` (mode decimal) or nothing (mode off)."""
    x = x or 0.0
    return "" if mode == "off" else f"${whole(x)}" if mode == "integer" else f"${x:.2f}"


def cell(n: float | None, x: float | None, mode: str) -> str:
    return tokens(n) if mode == "off" else f"{tokens(n)} ({cost(x, mode)})"


def duration(ms: float | None) -> str:
    s = int(ms or 0) // 1000
    h, m = s // 3600, s // 60
    return f"{h}h {m % 60}m" if h else f"{m}m {s % 60}s" if m else f"{s}s"


def project(path: str | None) -> str:
    """The last two components."""
    bits = [b for b in (path or "").split("/") if b]
    return ".../" + "/".join(bits[-2:]) if len(bits) > 2 else (path or "")


def span(low: int | None, high: int | None) -> str:
    if low is None or high is None:
        return DASH
    return f"{low}%" if low == high else f"{low}–{high}%"


def lines(added: int | None, removed: int | None) -> str:
    return f"+{added or 0} -{removed or 0}"


def axis_cost(x: float) -> str:
    return f"${whole(x)}" if x >= 10 or x == 0 else f"${x:.2f}"


def axis_tokens(x: float) -> str:
    return tokens(math.floor(x + 0.5))


def axis_percent(x: float) -> str:
    return f"{whole(x)}%"
