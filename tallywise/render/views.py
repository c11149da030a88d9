"""Grids and JSON documents of the engine's results; rows come from ``collect()`` of reports."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import UTC, date, datetime
from tallywise.options import python_zone

from tallywise.operators.grouping import CHILD as L_CHILD
from tallywise.operators.grouping import COSTS, COUNTERS, PARENT, TOTAL, TOTAL_CHILD
from tallywise.render import values as v
from tallywise.render.grid import CHILD, Grid


def _cells(r: Mapping, mode: str, compact: bool) -> list[str]:
    inn = [(r["input_tokens"], r["input_cost"]), (r["cache_creation_tokens"], r["cache_creation_cost"]), (r["cache_read_tokens"], r["cache_read_cost"])]
    all_in = (sum(n or 0 for n, _ in inn), sum(c or 0 for _, c in inn))
    out = (r["output_tokens"], r["output_cost"])
    tail = [all_in, out, (all_in[0] + (out[0] or 0), r["total_cost"])]
    return [v.cell(n, c, mode) for n, c in ([] if compact else inn) + tail]


def breakdown_grid(rows: Sequence[Mapping], label: str, mode: str = "integer", compact: bool = False) -> Grid:
    """Rows of :func:`tallywise.operators.grouping.in_order`."""
    g = Grid([label, *([] if compact else ["In", "Cache Cr", "Cache Rd"]), "In Total", "Out", "Total"])
    for r in rows:
        name = {PARENT: r["parent"], TOTAL: "TOTAL"}.get(r["level"], CHILD + (r["child"] or ""))
        row = [name or "", *_cells(r, mode, compact)]
        if r["level"] == TOTAL:
            g.totals.insert(0, row)
        else:
            (g.totals if r["level"] == TOTAL_CHILD else g.rows).append(row)
    return g


def _camel(s: str) -> str:
    a, *rest = s.split("_")
    return a + "".join(x.title() for x in rest)


def _plain(x: object) -> object:
    return x.isoformat() if isinstance(x, date | datetime) else x


def breakdown_json(rows: Sequence[Mapping], meta: Mapping, dedup: Mapping) -> str:
    """``{meta, data, totals, dedup}``; children only where there are two dimensions."""
    node = lambda r, name: {"label": name, **{_camel(c): r[c] for c in (*COUNTERS, *COSTS)}}
    data: dict[str | None, dict] = {}
    total: dict = {"label": "TOTAL"}
    for r in rows:
        if r["level"] == PARENT:
            data.setdefault(r["parent"], {}).update(node(r, r["parent"]))
        elif r["level"] == L_CHILD:
            data.setdefault(r["parent"], {}).setdefault("children", []).append(node(r, r["child"]))
        elif r["level"] == TOTAL_CHILD:
            total.setdefault("children", []).append(node(r, r["child"]))
        else:
            total.update(node(r, "TOTAL"))
    return json.dumps({"meta": dict(meta), "data": list(data.values()), "totals": total, "dedup": dict(dedup)}, indent=2, sort_keys=True, ensure_ascii=False, default=_plain)


def table_json(rows: Sequence[Mapping], meta: Mapping, totals: Mapping | None = None) -> str:
    """``{meta, data[, totals]}`` of a status view."""
    doc = {"meta": dict(meta), "data": [{_camel(k): _plain(x) for k, x in dict(r).items()} for r in rows]}
    if totals is not None:
        doc["totals"] = {_camel(k): _plain(x) for k, x in totals.items()}
    return json.dumps(doc, indent=2, sort_keys=True, ensure_ascii=False, default=_plain)


def _when(s: int | None, tz: str) -> str:
    return datetime.fromtimestamp(s, UTC).astimezone(python_zone(tz)).strftime("%Y-%m-%d %H:%M") if s is not None else v.DASH


_USE = ("total_cost_usd", "total_duration_ms", "total_api_duration_ms", "total_lines_added", "total_lines_removed")


def _use(r: Mapping, mode: str, compact: bool) -> list[str]:
    out = [v.cost(r["total_cost_usd"], mode) or v.DASH, v.duration(r["total_duration_ms"])]
    return out if compact else [*out, v.duration(r["total_api_duration_ms"]), v.lines(r["total_lines_added"], r["total_lines_removed"])]


def _sum(rows: Sequence[Mapping]) -> dict:
    low = lambda c: min((r[c] for r in rows if r[c] is not None), default=None)
    high = lambda c: max((r[c] for r in rows if r[c] is not None), default=None)
    d = {c: sum(r[c] or 0 for r in rows) for c in _USE}
    return d | {f"min_{w}_pct": low(f"min_{w}_pct") for w in ("five_hour", "seven_day")} | {f"max_{w}_pct": high(f"max_{w}_pct") for w in ("five_hour", "seven_day")}


def status_grid(rows: Sequence[Mapping], view: str, tz: str = "UTC", mode: str = "integer", compact: bool = False) -> Grid:
    """A session, project, day or window view."""
    first, count = {"session": ("Session", "Segs"), "project": ("Project", "Sess"), "day": ("Date", "Sess")}.get(view, ("Window", "Sess"))
    window = view in ("1h", "5h", "1w")
    extra = [("5h Resets" if view == "1h" else f"Est {view} Budg")] if window else []
    g = Grid([first, "Cost", "Duration", *([] if compact else ["API Time", "Lines"]), count, "5h%", "1w%", *extra])
    name = {
        "session": lambda r: r["session_id"][:8], "project": lambda r: v.project(r["project"]), "day": lambda r: r["day"],
    }.get(view, lambda r: f"{_when(r['window_start'], tz)} - {_when(r['window_end'], tz)[11:]}")
    pct = lambda r: [v.span(r["min_five_hour_pct"], r["max_five_hour_pct"]), v.span(r["min_seven_day_pct"], r["max_seven_day_pct"])]
    for r in rows:
        last = [_when(r["resets_at"], tz)[11:] if view == "1h" else v.cost(r["est_budget"], mode) if r["est_budget"] is not None else v.DASH] if window else []
        g.rows.append([name(r) or "", *_use(r, mode, compact), str(r["segments" if view == "session" else "sessions"]), *pct(r), *last])
    t = _sum(rows)
    n = sum(r["segments" if view == "session" else "sessions"] for r in rows) if view in ("session", "project") else None
    g.totals.append(["TOTAL", *_use(t, mode, compact), str(n) if n is not None else v.DASH, *pct(t), *([v.DASH] if window else [])])
    return g


def action_grid(rows: Sequence[Mapping], tz: str = "UTC", mode: str = "integer", compact: bool = False) -> Grid:
    g = Grid(["Time", "Cost", "5h%", "1w%", *([] if compact else ["5h Resets", "1w Resets", "Session"])])
    for r in rows:
        rest = [_when(r["five_hour_resets_at"], tz), _when(r["seven_day_resets_at"], tz), r["session_id"][:8]]
        g.rows.append([_when(r["ts"], tz), v.cost(r["cost_delta"], mode) or v.DASH, f"{r['five_hour_used_percentage']}%", f"{r['seven_day_used_percentage']}%", *([] if compact else rest)])
    total = v.cost(sum(r["cost_delta"] for r in rows), mode) or v.DASH
    g.totals.append(["TOTAL", total, *[v.DASH] * (len(g.headers) - 2)])
    return g


def diff_grid(rows: Sequence[Mapping], mode: str = "decimal") -> Grid:
    g = Grid(["Session", "Project", "Reported", "Computed", "Diff", "Diff %"])
    money = lambda x: v.DASH if x is None else v.cost(x, mode)
    for r in rows:
        pct = v.DASH if r["diff_pct"] is None else f"{r['diff_pct']:.1f}%"
        g.rows.append([r["session_id"][:8], v.project(r.get("project") or ""), money(r["total_cost_usd"]), money(r["computed_cost"]), money(r["diff"]), pct])
    ok = [r for r in rows if r["computed_cost"] is not None]
    a, b = sum(r["total_cost_usd"] for r in ok), sum(r["computed_cost"] for r in ok)
    off = len(rows) - len(ok)
    g.totals.append([f"TOTAL ({off} unmatched)" if off else "TOTAL", "", money(a), money(b), money(a - b), f"{(a - b) / b * 100:.1f}%" if b > 0 else v.DASH])
    return g


def raw_actions(rows: Sequence[Mapping], tz: str = "UTC") -> Grid:
    """Changes with whole ids and costs to six decimals, for CSV that is read by programs."""
    g = Grid(["Time", "Cost", "5h%", "1w%", "5h Resets", "1w Resets", "Session"])
    for r in rows:
        when = [_when(r[c], tz) for c in ("ts", "five_hour_resets_at", "seven_day_resets_at")]
        g.rows.append([when[0], f"{r['cost_delta']:.6f}", str(r["five_hour_used_percentage"]), str(r["seven_day_used_percentage"]), *when[1:], r["session_id"]])
    return g


def raw_sessions(rows: Sequence[Mapping]) -> Grid:
    """Sessions with whole ids and projects, costs to six decimals and plain counts."""
    g = Grid(["Session", "Project", "Cost", "Duration", "API Time", "Lines Added", "Lines Removed", "Ctx%", "Segments"])
    for r in rows:
        context = "" if r["max_context_pct"] is None else str(r["max_context_pct"])
        time = [v.duration(r["total_duration_ms"]), v.duration(r["total_api_duration_ms"])]
        g.rows.append([r["session_id"], r["project"], f"{r['total_cost_usd']:.6f}", *time, str(r["total_lines_added"]), str(r["total_lines_removed"]), context, str(r["segments"])])
    return g
