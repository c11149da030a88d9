"""Status files: one JSONL file of periodic snapshots."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywise.functions.json import Field, read, text, value
from tallywise.operators.status import percent
from tallywise.sources.lines import numbered_lines

#: name -> path of fields of each type; fixed values.
_TEXTS = {"session_id": "data.session_id", "project_dir": "data.workspace.project_dir", "model_id": "data.model.id"}
_OPTIONAL_TEXTS = {"display_name": "data.model.display_name", "client_version": "data.version"}
_COUNTS = {
    "total_duration_ms": "data.cost.total_duration_ms", "total_api_duration_ms": "data.cost.total_api_duration_ms",
    "context_window_size": "data.context_window.context_window_size",
}
_OPTIONAL_COUNTS = {"total_lines_added": "data.cost.total_lines_added", "total_lines_removed": "data.cost.total_lines_removed"}
_SHARES = {
    "context_used_percentage": "data.context_window.used_percentage", "five_hour_used_percentage": "data.rate_limits.five_hour.used_percentage",
    "seven_day_used_percentage": "data.rate_limits.seven_day.used_percentage",
}
_RESETS = {"five_hour_resets_at": "data.rate_limits.five_hour.resets_at", "seven_day_resets_at": "data.rate_limits.seven_day.resets_at"}


_FIELDS = [
    Field("ts", ("integer",), need=True),
    Field("data.cost.total_cost_usd", ("integer", "decimal"), need=True),
    *[Field(p, ("string",), need=True) for p in _TEXTS.values()],
    *[Field(p, ("integer",), need=True, count=True) for p in _COUNTS.values()],
    *[Field(p, ("string",), null=False) for p in _OPTIONAL_TEXTS.values()],
    *[Field(p, ("integer",), null=False, count=True) for p in _OPTIONAL_COUNTS.values()],
    *[Field(p, ("integer", "decimal")) for p in _SHARES.values()],
    *[Field(p, ("integer",)) for p in _RESETS.values()],
]


def _snapshot(x: dict) -> list:
    real = lambda p: None if (v := value(x, p)) is None else float(v)
    return [
        value(x, "ts"), *[text(value(x, p)) for p in _TEXTS.values()], *[text(value(x, p)) or "" for p in _OPTIONAL_TEXTS.values()], real("data.cost.total_cost_usd"),
        *[value(x, p) for p in _COUNTS.values()], *[value(x, p) or 0 for p in _OPTIONAL_COUNTS.values()], *[real(p) for p in _SHARES.values()], *[value(x, p) for p in _RESETS.values()],
    ]


def parse_status(lines: DataFrame) -> DataFrame:
    """Every line with ``ok`` (all required fields there and of the right type) and the status columns; ``snap_id`` is the line."""
    typed = [
        "ts bigint", *[f"{n} string" for n in (*_TEXTS, *_OPTIONAL_TEXTS)], "total_cost_usd double", *[f"{n} bigint" for n in (*_COUNTS, *_OPTIONAL_COUNTS)],
        *[f"{n} double" for n in _SHARES], *[f"{n} bigint" for n in _RESETS],
    ]
    names = [t.split()[0] for t in typed]
    d = read(lines.select("line", "body"), _FIELDS, _snapshot, names, ", ".join(typed), all_lines=True)
    return d.select("ok", F.col("line").cast("long").alias("snap_id"), *[percent(F.col(n)).alias(n) if n in _SHARES else F.col(n) for n in names])


def load_status(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(status rows, one row of loaded and malformed lines); a missing file is empty."""
    d = parse_status(numbered_lines(spark, [path] if os.path.exists(path) or "://" in path else []))
    counts = d.agg(F.count_if("ok").alias("loaded"), F.count_if(~F.col("ok")).alias("malformed"))
    return d.where("ok").drop("ok"), counts
