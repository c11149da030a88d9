"""Sequential models of the status operators, for comparison."""

from __future__ import annotations

import random

COUNTERS = ("total_cost_usd", "total_duration_ms", "total_api_duration_ms", "total_lines_added", "total_lines_removed")
SCHEMA = (
    "snap_id long, ts long, session_id string, project_dir string, model_id string, display_name string, client_version string, total_cost_usd double, total_duration_ms long, "
    "total_api_duration_ms long, total_lines_added long, total_lines_removed long, context_used_percentage double, five_hour_used_percentage double, five_hour_resets_at long, "
    "seven_day_used_percentage double, seven_day_resets_at long, _reset string, segment string"
)


def rows(n: int, seed: int, hot: bool = True) -> list[dict]:
    rnd, out, state = random.Random(seed), [], {}
    for i in range(n):
        s = "hot" if hot and rnd.random() < 0.4 else f"s{rnd.randint(0, 12)}"
        c = state.get(s) or [rnd.choice([0.0, 2.0]), rnd.choice([0, 5000]), 0, 0, 0]
        c = [0.0, 0, 0, 0, 0] if rnd.random() < 0.08 else [c[0] + rnd.choice([0, 0.25, 1]), c[1] + rnd.choice([0, 50, 900]), c[2] + rnd.choice([0, 10]), c[3] + rnd.randint(0, 3), c[4]]
        state[s] = c
        ts = 1_760_000_000 + i * 97 // 3 * 3 + rnd.choice([0, 0, -600])
        five = ts // 18_000 * 18_000 + 18_000 + rnd.choice([0, 0, -18_000])
        out.append(
            dict(zip(COUNTERS, c, strict=True))
            | {"snap_id": i, "ts": ts, "session_id": s, "project_dir": f"/p/{s[-1]}", "model_id": "m", "display_name": f"M{i % 3}", "client_version": "1"}
            | {"context_used_percentage": rnd.choice([None, 3.5, 60.2]), "five_hour_used_percentage": rnd.choice([None, 1.5, 2.5, 2.4, 90.0]), "_reset": "x", "segment": "y"}
            | {"five_hour_resets_at": rnd.choice([None, five, five]), "seven_day_used_percentage": rnd.choice([4.0, 4.0, 5.0]), "seven_day_resets_at": 1_760_400_000}
        )
    return out


def pct(x: float | None) -> int | None:
    return None if x is None else int(x + 0.5)


def reset(p: dict, r: dict) -> bool:
    a, b = "total_cost_usd", "total_duration_ms"
    return (p[a] > 1e-4 or p[b] > 100) and (r[a] < p[a] - 1e-4 or r[b] + 100 < p[b])


def by_session(data: list[dict]) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for r in sorted(data, key=lambda r: (r["ts"], r["snap_id"])):
        out.setdefault(r["session_id"], []).append(r)
    return out


def totals(recs: list[dict]) -> tuple[int, list[float]]:
    """(segments, totals) of rows in order."""
    done, cur, seg = [0.0] * 5, [0.0] * 5, 1
    for i, r in enumerate(recs):
        if i and reset(recs[i - 1], r):
            done, cur, seg = [a + b for a, b in zip(done, cur, strict=True)], [0.0] * 5, seg + 1
        cur = [max(a, r[c]) for a, c in zip(cur, COUNTERS, strict=True)]
    return seg, [a + b for a, b in zip(done, cur, strict=True)]


def sessions(data: list[dict]) -> dict[str, tuple]:
    out = {}
    for s, recs in by_session(data).items():
        seg, t = totals(recs)
        out[s] = (seg, *[max(0, a - recs[0][c]) for a, c in zip(t, COUNTERS, strict=True)])
    return out


def windows(data: list[dict], kind: str) -> dict[tuple, tuple]:
    col, length = ("seven_day_resets_at", 604_800) if kind == "1w" else ("five_hour_resets_at", 18_000)
    groups: dict[tuple, list[dict]] = {}
    for r in data:
        end = r[col]
        if end is None:
            continue
        if kind != "1h":
            groups.setdefault((end - length, end), []).append(r)
        elif 0 <= r["ts"] - (end - length) < length:
            start = end - length + (r["ts"] - (end - length)) // 3600 * 3600
            groups.setdefault((start, start + 3600), []).append(r)
    mine, out = by_session(data), {}
    for (a, b), recs in groups.items():
        spent = [0.0] * 5
        for s in {r["session_id"] for r in recs}:
            edge = lambda t, s=s: totals(x)[1] if (x := [r for r in mine[s] if r["ts"] < t]) else [mine[s][0][c] for c in COUNTERS]
            spent = [x + max(0, e - f) for x, e, f in zip(spent, edge(b), edge(a), strict=True)]
        five = [p for r in recs if (p := pct(r["five_hour_used_percentage"])) is not None]
        out[a, b] = (len({r["session_id"] for r in recs}), min(five, default=0), max(five, default=0), *spent)
    return out


def actions(data: list[dict]) -> list[tuple]:
    """(snap_id, cost) of changes and of the end flush."""
    order = sorted(data, key=lambda r: r["snap_id"])
    shown, pair, out, last = {}, None, {}, {}
    for r in order:
        shown.setdefault(r["session_id"], r["total_cost_usd"])
    spent = lambda now, was: now if now < was else now - was
    where = {}
    for r in order:
        p = pct(r["five_hour_used_percentage"]), pct(r["seven_day_used_percentage"])
        if None in (*p, r["five_hour_resets_at"], r["seven_day_resets_at"]):
            continue
        last[r["session_id"]] = r
        if p != pair:
            pair, s = p, r["session_id"]
            out[r["snap_id"]] = spent(r["total_cost_usd"], shown[s])
            shown[s], where[s] = r["total_cost_usd"], r["snap_id"]
    for s, r in last.items():
        rest = spent(r["total_cost_usd"], shown[s])
        if rest > 1e-9:
            k = where.get(s, r["snap_id"])
            out[k] = out.get(k, 0.0) + rest
    return sorted(out.items())
