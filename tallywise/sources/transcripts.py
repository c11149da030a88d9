"""Transcript trees: JSONL logs, one line per message."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywise.functions.json import Field, fits, read, text, value
from tallywise.operators import records
from tallywise.sources.lines import exists, jsonl_files, numbered_lines

#: Folders below the home directory that may hold logs; fixed values.
HOMES = (".claude", ".config/claude")
#: Where a line may have its time, in the order tried; fixed values.
TIMES = ("timestamp", "createdAt", "updatedAt", "message.timestamp", "message.createdAt", "snapshot.timestamp", "snapshot.createdAt")
_TEXTS = ("type", "requestId", "message.id", "message.model")
_COUNTS = {
    "input_tokens": "message.usage.input_tokens", "output_tokens": "message.usage.output_tokens",
    "cache_creation_tokens": "message.usage.cache_creation_input_tokens", "cache_read_tokens": "message.usage.cache_read_input_tokens",
}


def roots(folder: str | None = None, spark: SparkSession | None = None) -> list[str]:
    """The existing ``projects`` folders: of the one given, else of the homes; links to the same folder count once. A folder may be a URL that Spark can read."""
    if folder and "://" in folder:
        at = f"{folder.rstrip('/')}/projects"
        return [at] if exists(spark, at) else []
    homes = [folder] if folder else [os.path.join(os.path.expanduser("~"), h) for h in HOMES]
    return list(dict.fromkeys(os.path.realpath(p) for h in homes if os.path.isdir(p := os.path.join(h, "projects"))))


_FIELDS = [
    *[Field(p, ("string",)) for p in _TEXTS],
    *[Field(p, ("integer",), count=True) for p in _COUNTS.values()],
    *[Field(p, ("string", "integer", "decimal")) for p in TIMES],
    *[Field(p, ("object",)) for p in ("message", "message.usage", "snapshot")],
    Field("message.content", ("string", "array")),
]
_BLOCK = [(Field(p, ("string",)), (p,)) for p in ("type", "name")]


def _content(x: dict) -> bool:
    """Whether the content, if it is an array, has only objects whose type and name are texts."""
    blocks = value(x, "message.content")
    return not isinstance(blocks, list) or all(isinstance(b, dict) and fits(b, _BLOCK) for b in blocks)


def _message(x: dict) -> list:
    blocks = value(x, "message.content")
    tools = [text(b["name"]) for b in blocks if b.get("type") == "tool_use" and b.get("name") is not None] if isinstance(blocks, list) else None
    times = [("s" if isinstance(v, str) else "n") + text(v) for p in TIMES if (v := value(x, p)) is not None]
    return [*[text(value(x, p)) for p in _TEXTS], *[value(x, p) for p in _COUNTS.values()], times, tools]


def parse_lines(lines: DataFrame) -> DataFrame:
    """Message records from numbered lines; lines that don't have the expected types are dropped whole.

    Counters must be whole numbers of at least 0, names texts, times texts or
    numbers, content a text or an array of objects. Null counts as absent. Of the
    times the first that parses counts.
    """
    names = ["record_type", "request_id", "message_id", "model", *_COUNTS, "_times", "_tools"]
    shape = ", ".join([*[f"{n} string" for n in names[:4]], *[f"{n} bigint" for n in _COUNTS], "_times array<string>", "_tools array<string>"])
    d = read(lines, _FIELDS, _message, names, shape, check=_content)
    moment = F.transform("_times", lambda t: F.when(t.startswith("s"), records.parse_iso(F.substring(t, F.lit(2), F.length(t)))).otherwise(records.parse_number(F.substring(t, F.lit(2), F.length(t)))))
    where = records.session_agent_of(F.col("file_path"))
    return d.select(
        "file_path", "modified_at", "line", *names[:4], F.get(F.array_compact(moment), F.lit(0)).alias("record_timestamp"),
        records.project_of(F.col("file_path")).alias("project"), where["session_id"].alias("session_id"), where["agent_id"].alias("agent_id"),
        F.coalesce(records.tool_combination(F.col("_tools")), F.lit("")).alias("tool_names"), *_COUNTS,
    )


def read_records(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """All message records below the folders, before deduplication."""
    return parse_lines(numbered_lines(spark, [f for r in folders for f in jsonl_files(r, spark)]))


def load_usage(
    spark: SparkSession, folder: str | None = None, first: str | None = None, last: str | None = None, tz: str = "UTC", project: str | None = None,
    model: str | None = None, session: str | None = None, raw: DataFrame | None = None,
) -> DataFrame:
    """Usage records: read, validated, one copy of each message, times repaired, then the user's filters. ``raw`` are usable records read before."""
    d = records.usable(read_records(spark, roots(folder, spark))) if raw is None else raw
    d = records.keep_max(d, ["message_id", "request_id"], "output_tokens", ["file_path", "line"])
    d = records.repair_times(d, "file_path", ["line"], "record_timestamp", "modified_at")
    d = records.select_records(d, "record_timestamp", first, last, tz, project, model, session)
    d = records.zero_fill(d).withColumnRenamed("line", "line_no")
    return d.select(
        "record_timestamp", "model", "session_id", "project", "agent_id", "tool_names", "line_no", "input_tokens", "output_tokens",
        "cache_creation_tokens", "cache_read_tokens",
    )
