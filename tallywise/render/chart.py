"""Line charts of Braille dots."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from tallywise.render.values import axis_cost

#: Bit of a dot by (row, column) in a Braille cell; a fixed layout.
DOTS = ((0x01, 0x08), (0x02, 0x10), (0x04, 0x20), (0x40, 0x80))


def shape(labels: Sequence[str]) -> str:
    """hour, day or month by the form of the first label."""
    if not labels:
        return "day"
    x = labels[0]
    return "hour" if "T" in x or (len(x) > 10 and ":" in x) else "month" if len(x) == 7 else "day"


def short_label(x: str, grain: str) -> str:
    return x[5:16].replace("T", " ") if grain == "hour" else x[5:10] if grain == "day" else x[:7]


def line(x0: int, y0: int, x1: int, y1: int) -> Iterator[tuple[int, int]]:
    """Grid points from one point to another, one per step along the longer axis."""
    n = max(abs(x1 - x0), abs(y1 - y0))
    for i in range(n + 1):
        yield (x0, y0) if not n else (x0 + round((x1 - x0) * i / n), y0 + round((y1 - y0) * i / n))


def chart(labels: Sequence[str], values: Sequence[float], width: int = 80, height: int = 15, axis: Callable[[float], str] = axis_cost, top: float | None = None) -> str:
    """The values from 0 up, at most 6 marks at the left, labels of the ends and the middle below."""
    if not labels:
        return "No data to chart."
    high = top if top is not None else max(max(values), 0.0)
    marks = max(2, min(6, height))
    at = {round(i * (height - 1) / (marks - 1)): None for i in range(marks)} if height > 1 else {0: None}
    names = {r: axis(high * (1 - r / (height - 1)) if height > 1 else high) for r in at}
    left = max(map(len, names.values()))
    cols = max(10, width - left - 3)
    cells = [[0] * cols for _ in range(height)]
    w, h = cols * 2 - 1, height * 4 - 1
    pts = [
        (round(i * w / (len(values) - 1)) if len(values) > 1 else w // 2, h - round(v / high * h) if high > 0 else h) for i, v in enumerate(values)
    ]
    for (x0, y0), (x1, y1) in zip(pts, pts[1:] or pts, strict=False):
        for x, y in line(x0, max(0, min(h, y0)), x1, max(0, min(h, y1))):
            cells[y // 4][x // 2] |= DOTS[y % 4][x % 2]
    out = [f"{names.get(r, ''):>{left}} ┤" + "".join(chr(0x2800 + c) for c in row) for r, row in enumerate(cells)]
    out.append(" " * left + " └" + "─" * cols)
    g = shape(labels)
    first, mid, last = (short_label(labels[i], g) for i in (0, len(labels) // 2, -1))
    foot = first
    if len(labels) > 2:
        foot = foot.ljust(max(len(first) + 1, cols // 2 - len(mid) // 2)) + mid
    if len(labels) > 1:
        foot = foot.ljust(max(len(foot) + 1, cols - len(last))) + last
    return "\n".join([*out, " " * (left + 2) + foot])
