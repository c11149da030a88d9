"""A grid of text cells, as box table, CSV, TSV, Markdown or HTML."""

from __future__ import annotations

import csv
import html
import io
import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

_ANSI = re.compile(r"\x1b\[[0-9;]*m")
CHILD = "└─ "
#: Headers that are shortened in tables only; fixed values.
LONG = {"Sess": "Sessions", "Segs": "Segments", "Budg": "Budget", "In": "Input", "Out": "Output", "Cache Cr": "Cache Creation", "Cache Rd": "Cache Read"}


@dataclass
class Grid:
    """Header, rows (label first) and totals rows."""

    headers: list[str]
    rows: list[list[str]] = field(default_factory=list)
    totals: list[list[str]] = field(default_factory=list)


def width(text: str) -> int:
    """Characters shown, without colour codes."""
    return len(_ANSI.sub("", text))


def box(g: Grid, colour: bool = False) -> str:
    """A box table; numbers to the right, totals below a line of their own."""
    every = [g.headers, *g.rows, *g.totals]
    w = [max(width(r[i]) for r in every) for i in range(len(g.headers))]

    def line(r: Sequence[str], yellow: bool = False) -> str:
        cells = [(x + " " * (w[i] - width(x))) if i == 0 else (" " * (w[i] - width(x)) + x) for i, x in enumerate(r)]
        if yellow and colour:
            cells = [f"\x1b[33m{c}\x1b[0m" for c in cells]
        return "│ " + " │ ".join(cells) + " │"

    def rule(a: str, b: str, c: str) -> str:
        return a + b.join("─" * (x + 2) for x in w) + c

    out = [rule("┌", "┬", "┐"), line(g.headers), rule("├", "┼", "┤"), *map(line, g.rows)]
    if g.totals:
        out += [rule("├", "┼", "┤"), *(line(r, True) for r in g.totals)]
    return "\n".join([*out, rule("└", "┴", "┘")])


def long_headers(g: Grid) -> list[str]:
    return [LONG.get(h, " ".join(LONG.get(x, x) for x in h.split(" "))) for h in g.headers]


def to_csv(g: Grid) -> str:
    """Quotes where a cell has a comma, quote or line break."""
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([g.headers, *g.rows, *g.totals])
    return out.getvalue().rstrip("\n")


def to_tsv(g: Grid, quoted: bool = False) -> str:
    """Backslash escapes, or with ``quoted`` quotes as in CSV."""
    if quoted:
        out = io.StringIO()
        csv.writer(out, delimiter="\t", lineterminator="\n").writerows([g.headers, *g.rows, *g.totals])
        return out.getvalue().rstrip("\n")
    esc = lambda x: x.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")
    return "\n".join("\t".join(map(esc, r)) for r in [g.headers, *g.rows, *g.totals])


def to_markdown(g: Grid) -> str:
    esc = lambda x: x.replace("|", "\\|")
    line = lambda r: "| " + " | ".join(map(esc, r)) + " |"
    align = "| " + " | ".join(":---" if i == 0 else "---:" for i in range(len(g.headers))) + " |"
    bold = [[f"**{x}**" if x else x for x in r] for r in g.totals]
    return "\n".join([line(g.headers), align, *map(line, g.rows), *map(line, bold)])


_STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}th,td{padding:.3em .8em;border:1px solid #bbb;text-align:right}th:first-child,td:first-child{text-align:left}th{cursor:pointer}tfoot{font-weight:bold}"
_SCRIPT = """
const scale = {K: 1e3, M: 1e6};
function number(text) {
  const time = [...text.matchAll(/(\\d+)([hms])/g)];
  if (time.length) return time.reduce((s, m) => s + m[1] * {h: 3600, m: 60, s: 1}[m[2]], 0);
  const m = text.replace(/,/g, '').match(/-?\\$?-?(\\d+(?:\\.\\d+)?)([KM]?)/);
  return m ? parseFloat(m[0].replace('$', '')) * (scale[m[2]] || 1) : null;
}
document.querySelectorAll('th').forEach((th, i) => th.addEventListener('click', () => {
  const body = th.closest('table').tBodies[0], up = th.dataset.up = th.dataset.up === '1' ? '0' : '1';
  const groups = [];
  for (const row of body.rows) row.classList.contains('child') ? groups.at(-1).push(row) : groups.push([row]);
  groups.sort((a, b) => {
    const [x, y] = [a, b].map(g => g[0].cells[i].textContent), [p, q] = [number(x), number(y)];
    return (p !== null && q !== null ? p - q : x.localeCompare(y)) * (up === '1' ? 1 : -1);
  });
  groups.flat().forEach(r => body.append(r));
}));
"""


def to_html(g: Grid, title: str) -> str:
    """One page without references; a click on a header sorts, children stay with their parents."""
    e = html.escape
    head = "".join(f"<th>{e(h)}</th>" for h in long_headers(g))

    def row(r: Sequence[str]) -> str:
        kind = ' class="child"' if r[0].startswith(CHILD) else ""
        return f"<tr{kind}>" + "".join(f"<td>{e(x)}</td>" for x in r) + "</tr>"

    body, foot = "\n".join(map(row, g.rows)), "\n".join(map(row, g.totals))
    return (
        f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{e(title)}</title><style>{_STYLE}</style></head>\n<body><h1>{e(title)}</h1>\n'
        f"<table><thead><tr>{head}</tr></thead>\n<tbody>\n{body}\n</tbody>\n<tfoot>\n{foot}\n</tfoot></table>\n<script>{_SCRIPT}</script></body></html>"
    )


def to_json(g: Grid) -> str:
    """An array of objects of texts by header, totals last."""
    bare = lambda r: {h: _ANSI.sub("", x) for h, x in zip(g.headers, r, strict=True)}
    return json.dumps([bare(r) for r in [*g.rows, *g.totals]], indent=2, ensure_ascii=False)


def without_totals(g: Grid) -> Grid:
    return Grid(g.headers, g.rows)


def render(g: Grid, form: str, title: str = "", colour: bool = False, quoted_tsv: bool = False) -> str:
    return {
        "txt": lambda: box(g, colour), "csv": lambda: to_csv(g), "tsv": lambda: to_tsv(g, quoted_tsv), "markdown": lambda: to_markdown(g),
        "html": lambda: to_html(g, title), "json": lambda: to_json(g),
    }[form]()
