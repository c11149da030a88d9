"""Command line: breakdowns of transcripts, and views of a status file (``sl``)."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallywise import options
from tallywise.operators import costdiff, grouping, pricing, records, status
from tallywise.plans.scale import clean, materialise
from tallywise.render import grid, values, views
from tallywise.render.chart import chart
from tallywise.render.clipboard import osc52
from tallywise.session import get_session
from tallywise.sources import prices, transcripts
from tallywise.sources.status import load_status


VERSION = "tallywise 0.2"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallywise", description="Reports from assistant usage logs.")
    _common(p)
    p.add_argument("--per", action="append", help="up to two of " + ", ".join(grouping.DIMENSIONS))
    p.add_argument("--chart", help="one of " + ", ".join(options.CHARTS[False]))
    p.add_argument("-v", "--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command")
    s = sub.add_parser("sl", help="views of a status file")
    _common(s)
    s.add_argument("--file", default=os.path.expanduser("~/.claude/statusline.jsonl"))
    s.add_argument("--per", action="append", help="one of " + ", ".join(options.VIEWS))
    s.add_argument("--chart", help="one of " + ", ".join(options.CHARTS[True]))
    s.add_argument("--cost-diff", action="store_true")
    s.add_argument("--intervals", help="file of 'start end' epoch seconds a line, for budgets")
    s.add_argument("--nopromo", action="store_true", help="leave --intervals out of budgets")
    return p


def _common(p: argparse.ArgumentParser) -> None:
    for a in ("from", "to", *options.SHORTCUTS):
        p.add_argument(f"--{a}", dest=a)
    for a in ("tz", "project", "model", "session", "filename", "log-dir", "pricing-url", "output"):
        p.add_argument(f"--{a}")
    p.add_argument("--pricing-data", action="append", help="catalog file; entries of a later one replace those of the same name")
    p.add_argument("--live-pricing", action="store_true", help="catalog from --pricing-url")
    p.add_argument("--provider", action="append", default=[], help="prefix of model names to keep from --pricing-url")
    for a, default in (("cost", "true"), ("order", "asc"), ("table", "auto"), ("copy", None)):
        p.add_argument(f"--{a}", default=default, help="one of " + ", ".join(options.CHOICES[a]))


def _mode(o) -> str:
    return {"true": "integer", "false": "off", "decimal": "decimal"}[o.cost]


def _compact(o) -> bool:
    if o.table != "auto":
        return o.table == "compact"
    try:
        return os.get_terminal_size().columns < 120
    except OSError:
        return False


def _catalog(spark: SparkSession, o):
    """(catalog, when it was fetched): live, or all files laid over each other."""
    if o.live_pricing:
        return prices.fetch_catalog(spark, o.pricing_url, o.provider), "live"
    out, at = spark.createDataFrame([], prices.SCHEMA), ""
    for path in o.pricing_data or ():
        own, fetched = prices.load_catalog(spark, path)
        out, at = pricing.overlay(out, own), fetched or at
    return out, at


@dataclass
class Report:
    """A report that can be given in any format; ``note`` goes with text."""

    give: Callable[[str], str]
    note: str = ""

    def text(self, form: str) -> str:
        return f"{self.give(form)}\n{self.note}" if form == "txt" and self.note else self.give(form)


def _write(text: str, o, name: str) -> None:
    """To standard output (``-`` or a table without a file name), else to a file."""
    if o.filename == "-" or (not o.filename and not o.output):
        print(text)
        return
    path = o.filename or f"{name}.{options.EXTENSIONS[o.output or 'txt']}"
    with open(path, "w", encoding="utf-8") as f:
        f.write(text + "\n")


def run_records(spark: SparkSession, o) -> Report:
    tz = options.zone(o.tz)
    first, last = options.date_range(vars(o)["from"], o.to, vars(o))
    dims = o.per or ["day", "model"]
    # The tree is read and parsed once.
    raw = materialise(records.usable(transcripts.read_records(spark, transcripts.roots(o.log_dir, spark))))
    use = materialise(transcripts.load_usage(spark, o.log_dir, first, last, tz, o.project, o.model, o.session, raw))
    catalog, fetched = _catalog(spark, o)
    for r in pricing.unpriced(use, catalog).toLocalIterator() if not catalog.isEmpty() else ():
        print(f"no price for model {r['model']!r}; its cost is 0", file=sys.stderr)
    priced = pricing.price(use, catalog)
    rows = [r.asDict() for r in grouping.in_order(grouping.breakdown(priced, dims, tz), o.order == "desc").collect()]
    dedup = records.dedup_counts(raw, ["message_id", "request_id"], "output_tokens", ["file_path", "line"]).first().asDict()
    if o.chart:
        main = [r for r in rows if r["level"] == grouping.PARENT]
        total = lambda r: sum(r[c] or 0 for c in grouping.COUNTERS)
        y = [r["total_cost"] if o.chart == "cost" else total(r) for r in main]
        drawn = chart([r["parent"] or "" for r in main], y, axis=values.axis_cost if o.chart == "cost" else values.axis_tokens)
        return Report(lambda form: drawn)
    label = " / ".join(x.title() for x in dims)

    def give(form: str) -> str:
        if form != "json":
            return grid.render(views.breakdown_grid(rows, label, _mode(o), _compact(o)), form, "Usage by " + label, form == "txt" and sys.stdout.isatty() and not o.filename)
        m = records.metadata(use).first().asDict()
        names = {}
        for r in records.names(use).orderBy("kind", "name").toLocalIterator():
            names.setdefault(r["kind"] + "s", []).append(r["name"])
        meta = {"dimensions": dims, "from": first, "to": last, "tz": o.tz, "project": o.project, "model": o.model, "session": o.session, "order": o.order}
        meta |= {"earliest": m["earliest"], "latest": m["latest"], "pricingDate": fetched, "generatedAt": datetime.now(UTC).isoformat()}
        meta |= {k: names.get(k, []) for k in ("projects", "models", "sessions")}
        return views.breakdown_json(rows, meta, dedup)

    note = f"{dedup['before'] - dedup['after']} repeated messages left out of {dedup['before']}" + (f"; prices of {fetched}" if fetched else "")
    print(note, file=sys.stderr)
    return Report(give, note if o.output == "txt" else "")


def run_status(spark: SparkSession, o) -> Report:
    tz = options.zone(o.tz)
    view = (o.per or ["5h"])[0]
    first, last = options.date_range(vars(o)["from"], o.to, vars(o))
    d, counts = load_status(spark, o.file)
    n = counts.first()
    print(f"{n['loaded']} loaded, {n['malformed']} malformed", file=sys.stderr)
    d = status.select_status(d, first, last, tz, o.session, o.project, o.model)
    intervals = []
    if o.intervals and not o.nopromo:
        with open(o.intervals, encoding="utf-8") as f:
            intervals = [tuple(map(int, x.split()[:2])) for x in f if x.strip()]
    down = o.order == "desc"
    by = lambda *c: [F.col(x).desc() if down else F.col(x).asc() for x in c]
    if o.chart == "cost":
        rows = status.cumulative_cost(status.sessions(d)).orderBy("session_id").collect()
        drawn = chart([datetime.fromtimestamp(r["first_ts"], UTC).isoformat() for r in rows], [r["cumulative"] for r in rows])
        return Report(lambda form: drawn)
    if o.chart:
        col = status.S.five_hour if o.chart == "5h" else status.S.seven_day
        rows = status.actions(d).orderBy("flushed", "snap_id").collect()
        drawn = chart([datetime.fromtimestamp(r["ts"], UTC).isoformat() for r in rows], [r[col] for r in rows], axis=values.axis_percent, top=100)
        return Report(lambda form: drawn)
    total = None
    if view == "action":
        # Changes are in file order, rows of the end flush last.
        rows = [r.asDict() for r in status.actions(d).orderBy(*by("flushed", "snap_id")).collect()]
    elif view in ("1h", "5h", "1w"):
        w = status.windows(d, view, intervals)
        rows = [r.asDict() for r in status.windows_in_range(w, first, last, tz).orderBy(*by("window_start", "window_end")).collect()]
    else:
        s = status.sessions(d)
        s = {"session": lambda: s, "project": lambda: status.by_project(s), "day": lambda: status.by_day(s, tz)}[view]()
        if o.cost_diff:
            catalog, _ = _catalog(spark, o)
            use = pricing.price(transcripts.load_usage(spark, o.log_dir, first, last, tz, o.project, o.model, o.session), catalog)
            s = materialise(costdiff.cost_diff(s, use.groupBy("session_id").agg(F.sum("total_cost").alias("total_cost"))))
        rows = [r.asDict() for r in s.orderBy(*by({"session": "session_id"}.get(view, view))).collect()]
        if o.cost_diff:
            t = costdiff.diff_totals(s).first()
            total = {"reported": t["reported"], "computed": t["computed"] if t["matched"] else None, "count": len(rows), "matched_count": t["matched"], "unmatched_count": t["unmatched"]}
        elif view == "session":
            total = {"session_count": len(rows), **{c: sum(r[c] or 0 for r in rows) for c in status.S.counters}}

    def give(form: str) -> str:
        if form == "json":
            meta = {"source": "status", "file": o.file, "view": view, "from": first, "to": last, "tz": o.tz, "generatedAt": datetime.now(UTC).isoformat()}
            return views.table_json(rows, meta, total)
        if o.cost_diff:
            g = views.diff_grid(rows, "decimal")
        elif view == "action":
            g = views.action_grid(rows, tz, _mode(o), _compact(o))
        else:
            g = views.status_grid(rows, view, tz, _mode(o), _compact(o))
        if form != "txt":
            g.headers = grid.long_headers(g)
        return grid.render(g, form, f"Status by {view}", form == "txt" and sys.stdout.isatty() and not o.filename, quoted_tsv=True)

    return Report(give)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(argv)
    wrong = options.errors(vars(o), o.command == "sl")
    for e in wrong:
        print(e, file=sys.stderr)
    if wrong:
        return 1
    spark = spark or get_session()
    report = run_status(spark, o) if o.command == "sl" else run_records(spark, o)
    if o.copy:
        sys.stderr.write(osc52(report.give(o.copy)))
        print(f"copied {o.copy} to the clipboard", file=sys.stderr)
    text = report.text(o.output or "txt")
    _write(text, o, "status" if o.command == "sl" else "usage")
    clean()
    return 0


if __name__ == "__main__":
    sys.exit(main())
