"""The library in one place: load, price, group, view, render."""

from __future__ import annotations

from tallywise.operators.costdiff import cost_diff, diff_totals
from tallywise.operators.grouping import breakdown, in_order, series
from tallywise.operators.pricing import match_models, overlay, price, unpriced
from tallywise.operators.records import dedup_counts, keep_max, metadata, names, repair_times, select_records
from tallywise.operators.status import actions, by_day, by_project, cumulative_cost, select_status, sessions, totals, windows, windows_in_range
from tallywise.render.chart import chart
from tallywise.render.grid import Grid, render
from tallywise.session import get_session
from tallywise.sources.prices import fetch_catalog, load_catalog
from tallywise.sources.status import load_status
from tallywise.sources.transcripts import load_usage, read_records

__all__ = [
    "Grid", "actions", "breakdown", "by_day", "by_project", "chart", "cost_diff", "cumulative_cost", "dedup_counts", "diff_totals", "fetch_catalog",
    "get_session", "in_order", "keep_max", "load_catalog", "load_status", "load_usage", "match_models", "metadata", "names", "overlay", "price",
    "read_records", "render", "repair_times", "select_records", "select_status", "series", "sessions", "totals", "unpriced", "windows", "windows_in_range",
]
