"""Schemas that drift between files: rescue-column ingestion and a report of changes.

1. :func:`ingest` enforces the target schema; a field that is unknown, or whose
   value isn't of the target's type, is kept as JSON text under its path.
2. :func:`approve` finds rescued paths that name a target in other words, and
   :func:`candidates` weighs those that only stand where a target is missing.
3. :func:`promote` replays rescued values of approved paths into typed columns.
4. :func:`drift_report` compares each file with the one opened before it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywise.functions.json import plain, refuse
from tallywise.plans.ordered import Ordered
from tallywise.plans.scale import materialise


@dataclass(frozen=True)
class Target:
    """A target field: its path, Spark type, and how other names for it are made.

    ``ideas``: groups of words for the same thing; a path that has a word of each
    group, and otherwise only words of the target or GENERIC ones, names the target.
    ``parts``: number fields whose sum stands for a value that is an object.
    """

    name: str
    path: str
    type: str = "long"
    ideas: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()


#: Words that say nothing about which quantity a name means.
GENERIC = frozenset("data message usage cost total totals sum overall count number num value".split())
_LINES = "line lines loc sloc code diff"
#: The target schema of log lines.
LOG_LINES = (
    Target("ts", "ts"),
    Target("session_id", "data.session_id", "string"),
    Target("project_dir", "data.workspace.project_dir", "string"),
    Target("model_id", "data.model.id", "string"),
    Target("total_cost_usd", "data.cost.total_cost_usd", "double", ("usd dollars", "cost price spent")),
    Target("total_duration_ms", "data.cost.total_duration_ms"),
    Target("total_api_duration_ms", "data.cost.total_api_duration_ms"),
    Target("total_lines_added", "data.cost.total_lines_added", "long", (_LINES, "add added adds addition additions insert inserted inserts insertion insertions"), ("count",)),
    Target("total_lines_removed", "data.cost.total_lines_removed", "long", (_LINES, "remove removed removes removal removals delete deleted deletes deletion deletions"), ("count",)),
    Target("context_window_size", "data.context_window.context_window_size"),
    Target("version", "data.version", "string"),
    Target("type", "type", "string"),
    Target("request_id", "requestId", "string"),
    Target("line_timestamp", "timestamp", "string"),
    Target("message_id", "message.id", "string"),
    Target("model", "message.model", "string"),
    Target("input_tokens", "message.usage.input_tokens"),
    Target("output_tokens", "message.usage.output_tokens"),
    Target("cache_read_input_tokens", "message.usage.cache_read_input_tokens", "long", ("cache cached", "read reads")),
    Target(
        "cache_creation_input_tokens", "message.usage.cache_creation_input_tokens", "long", ("cache cached", "creation creations create created write writes written"), ("short_lived", "long_lived"),
    ),
)
WATCHED = ("total_lines_added", "total_lines_removed", "cache_creation_input_tokens")


#: Evidence that accepts a path without regard to its name: so many files would have to have it beside the target by chance, yet none
#: has, and in so many files it takes the place of the target that the file before had.
CHANCE, SWAPS = 10.0, 5
_LONG = 1 << 63
Registry = Mapping[str, Sequence[str]]


def _kind(x: object) -> str | None:
    if x is None:
        return None
    if isinstance(x, bool):
        return "boolean"
    if isinstance(x, int):
        return "integer"
    return {float: "decimal", str: "string", dict: "object"}.get(type(x), "array")


_DECODER = json.JSONDecoder(parse_constant=refuse)


def _fits(x: object, kind: str) -> bool:
    if kind == "long":
        return type(x) is int and -_LONG <= x < _LONG
    if kind == "double":
        return type(x) in (int, float) and abs(x) < 1e300
    return isinstance(x, str) and plain(x) == x


def _json(x: object) -> str:
    if type(x) is int:
        return str(x)
    return "null" if x is None else plain(json.dumps(x, separators=(",", ":"), ensure_ascii=False))


@cache
def _places(targets: tuple[Target, ...]) -> dict[str, int]:
    return {t.path: i for i, t in enumerate(targets)}


def read_line(body: str | None, targets: tuple[Target, ...], boxes: frozenset[str]) -> tuple[list, dict] | None:
    """(target values, rescued path -> (kind, json)) of a line; None if it isn't a JSON object.

    An unknown object is rescued whole and, besides, by every path below it.
    """
    try:
        line = _DECODER.decode(body) if body else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(line, dict):
        return None
    typed: list = [None] * len(targets)
    rescued: dict = {}
    at = _places(targets)

    def walk(inside: dict, prefix: str) -> None:
        for k, x in inside.items():
            path = prefix + plain(k)
            i = at.get(path)
            if i is not None and _fits(x, targets[i].type):
                typed[i] = float(x) if targets[i].type == "double" else x
                continue
            if isinstance(x, dict) and path in boxes:
                walk(x, path + ".")
                continue
            if x is None and i is not None:
                continue
            rescued[path] = _kind(x), _json(x)
            if isinstance(x, dict):
                walk(x, path + ".")

    try:
        walk(line, "")
    except RecursionError:
        return None
    return typed, rescued


def ingest(lines: DataFrame, body: str = "body", targets: tuple[Target, ...] = LOG_LINES) -> DataFrame:
    """``lines`` without ``body``, with ``_readable``, the typed targets and ``_rescued``.

    A line is readable if it is a JSON object. ``_rescued`` maps a path to
    (kind, json) for every field that isn't a target, or whose value isn't null and
    doesn't fit the target's type; nothing of a readable line is lost, but of a name
    that comes twice in an object the last counts. Null, blank and broken bodies give
    null targets and a null ``_rescued``. A column of ``lines`` that has the name of a
    target is replaced. Lines are parsed once, whatever paths are asked for later.
    """
    names = [t.name for t in targets]
    keep = [c for c in lines.columns if c != body and c not in {*names, "_readable", "_rescued"}]
    boxes = frozenset(".".join(t.path.split(".")[:i]) for t in targets for i in range(1, t.path.count(".") + 1))
    types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = [read_line(x, targets, boxes) for x in b.column(b.num_columns - 1).to_pylist()]
            cols = [pa.array([r is not None for r in read], pa.bool_())]
            cols += [pa.array([r[0][i] if r else None for r in read], types[t.type]) for i, t in enumerate(targets)]
            flat = [(p, k, v) for r in read if r for p, (k, v) in r[1].items()]
            ends = np.cumsum([0, *[len(r[1]) if r else 0 for r in read]])
            start = pa.array(ends, pa.int32(), mask=np.array([*[r is None for r in read], False]))
            p, k, v = (pa.array(x, pa.string()) for x in (zip(*flat, strict=True) if flat else ((), (), ())))
            cols.append(pa.MapArray.from_arrays(start, p, pa.StructArray.from_arrays([k, v], names=["kind", "json"])))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*b.schema.names[:-1], "_readable", *names, "_rescued"])

    first = lines.select(*[F.col(f"`{c}`") for c in keep], F.col(body).alias("_body"))
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in first.schema.fields[:-1])
    body_types = ", ".join(f"{t.name} {'bigint' if t.type == 'long' else t.type}" for t in targets)
    return first.mapInArrow(run, f"{head}_readable boolean, {body_types}, _rescued map<string,struct<kind:string,json:string>>")


def words(path: str) -> list[str]:
    """The words of a path: parts between dots, underscores, dashes and blanks, and of camel case."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+", path)]


def names_target(path: str, t: Target) -> bool:
    """Whether a path names the target in other words: under the same root, a word of each idea, no foreign word, and a last part that says something of it."""
    if not t.ideas or path == t.path or path.split(".")[0] != t.path.split(".")[0]:
        return False
    ideas = [set(i.split()) for i in t.ideas]
    own = set(words(t.path)).union(*ideas)
    have = words(path)
    last = set(words(path.rpartition(".")[2])) & (own - GENERIC)
    return bool(last) and all(i & set(have) for i in ideas) and all(w in own or w in GENERIC for w in have)


def paths(ingested: DataFrame, file: str = "file_id") -> DataFrame:
    """(file, path, lines, number): the rescued paths of each file with a value other than null; ``number`` if some value may be one, as text or within an object."""
    some = F.map_entries(F.map_filter("_rescued", lambda k, x: x["kind"].isNotNull()))
    d = ingested.select(file, F.explode(some).alias("x")).select(file, F.col("x.key").alias("path"), F.col("x.value.kind").alias("k"), F.col("x.value.json").alias("j"))
    may = F.col("k").isin("integer", "decimal", "object") | ((F.col("k") == "string") & F.col("j").rlike(r'^"-?[0-9.]+"$'))
    return d.groupBy(file, "path").agg(F.count(F.lit(1)).alias("lines"), F.max(may).alias("number"))


def approve(found: DataFrame, targets: tuple[Target, ...] = LOG_LINES, more: Registry | None = None) -> dict[str, list[str]]:
    """Approved paths by target: those of ``more``, and those of ``found`` (a ``path`` column) that name a target.

    Of a path and one below it that both do, the lower is meant. Paths are filtered
    where they lie; only spellings made of a target's own words reach the driver.
    """
    ideas = sorted({w for t in targets for i in t.ideas for w in i.split()})
    near = found.where(F.col("path").rlike("(?i)" + "|".join(ideas))) if ideas else found.where("false")
    all_ = [t for t in targets if t.ideas]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(t.name, p) for p in b.column(0).to_pylist() for t in all_ if names_target(p, t)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["name", "path"])

    out: dict[str, list[str]] = {t.name: list((more or {}).get(t.name, ())) for t in targets}
    rows = sorted(tuple(r) for r in near.select("path").distinct().mapInArrow(run, "name string, path string").distinct().collect())
    for name, p in rows:
        if p not in out[name] and not any(n == name and q.startswith(p + ".") for n, q in rows):
            out[name].append(p)
    return out


def candidates(
    ingested: DataFrame, files: DataFrame, targets: tuple[Target, ...] = LOG_LINES, trace: tuple[str, ...] = WATCHED, approved: Registry | None = None,
    found: DataFrame | None = None, file: str = "file_id", stream: str = "stream_id", opened: str = "opened_at",
) -> DataFrame:
    """(field_name, path, files, together, expected, swaps, accepted): rescued paths of numbers that may be a target under a new name.

    ``swaps`` counts files in which a path appears and a target is gone that the
    stream's file before had without the path; ``together`` files that have both, and
    ``expected`` how many would by chance. ``accepted`` asks for CHANCE, SWAPS, no file
    with both, and no other target of which that holds. Targets and approved paths, what is above and what is
    below them aren't listed. ``found`` are the :func:`paths`, if they are at hand.
    """
    root = {t.name: t.path.split(".")[0] for t in targets}
    found = materialise(paths(ingested, file)) if found is None else found
    ways = {t.name: (t.path, *(approved or {}).get(t.name, ())) for t in targets}
    skip = [p for w in ways.values() for p in w]
    above = {".".join(p.split(".")[:i]) for p in skip for i in range(1, p.count(".") + 1)}
    own = ingested.groupBy(file).agg(*[F.max(F.col(n).isNotNull()).alias(n) for n in trace])
    other = found.where(F.col("path").isin(*[p for n in trace for p in ways[n]])).groupBy(file).agg(*[F.max(F.col("path").isin(*ways[n])).alias(n) for n in trace])
    seen = own.unionByName(other).groupBy(file).agg(*[F.max(n).alias(n) for n in trace])
    below = F.exists(F.array(*[F.lit(p + ".") for p in skip]), lambda p: F.startswith(F.col("path"), p))
    new = found.where(F.col("number") & ~F.col("path").isin(*skip, *above) & ~below).select(file, "path")
    d = files.select(file, stream, opened).where(F.col(stream).isNotNull() & F.col(opened).isNotNull()).join(seen, file, "left")
    d = Ordered(d, [stream], [opened]).lag([file, *trace]).df
    for n in trace:
        d = d.withColumns({n: F.coalesce(n, F.lit(False)), f"prev_{n}": F.coalesce(f"prev_{n}", F.lit(False))})
    d = materialise(d)
    all_ = d.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(n).cast("int")).alias(n) for n in trace]).first()
    before = new.select(F.col(file).alias(f"prev_{file}"), "path", F.lit(True).alias("_had"))
    j = new.join(d, file).join(before, [f"prev_{file}", "path"], "left")
    one = [
        F.struct(F.lit(n).alias("field_name"), F.col(n).alias("both"), (~F.col(n) & F.col(f"prev_{n}") & F.col("_had").isNull()).alias("swap"), F.lit(float(all_[n] or 0.0)).alias("share"), F.lit(root[n]).alias("root"))
        for n in trace
    ]
    j = j.select("path", F.explode(F.array(*one)).alias("x")).select("path", "x.*").where(F.substring_index("path", ".", 1) == F.col("root"))
    g = j.groupBy("field_name", "path").agg(
        F.count(F.lit(1)).alias("files"), F.count_if("both").alias("together"), (F.count(F.lit(1)) * F.first("share")).alias("expected"), F.count_if("swap").alias("swaps")
    )
    ok = (F.col("together") == 0) & (F.col("expected") >= CHANCE) & (F.col("swaps") >= SWAPS)
    g = g.withColumn("_ok", ok)
    alone = g.groupBy("path").agg(F.count_if("_ok").alias("_n"))
    return g.join(alone, "path").select("field_name", "path", "files", "together", "expected", "swaps", (F.col("_ok") & (F.col("_n") == 1)).alias("accepted")).where("swaps > 0")


def accept(found: DataFrame, approved: Registry) -> dict[str, list[str]]:
    """``approved`` and the accepted :func:`candidates`.

    Of a path and one below it, the lower is meant if it is in at least half of the
    files, as in an object made for one field; else the upper, whose value then is an object.
    """
    out = {k: list(v) for k, v in approved.items()}
    rows = {(r["field_name"], r["path"]): r["files"] for r in found.where("accepted").collect()}
    for (name, p), n in sorted(rows.items(), key=lambda x: len(x[0][1])):
        lower = any(k == name and q.startswith(p + ".") and 2 * m >= n for (k, q), m in rows.items())
        if not lower and not any(p.startswith(q + ".") for q in out.get(name, ())):
            out.setdefault(name, []).append(p)
    return out


def _replay(x: Column, t: Target) -> Column:
    """A rescued value as the target's type; null where it can't be."""
    text = F.when(x["kind"] == "string", F.from_json(F.concat(F.lit('{"v":'), x["json"], F.lit("}")), "v string")["v"]).otherwise(x["json"])
    if t.type == "string":
        return text
    number = F.trim(text).try_cast("double")
    if t.parts:
        parts = [F.get_json_object(x["json"], f"$.{p}").try_cast("double") for p in t.parts]
        some = F.coalesce(*parts)
        total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
        number = F.when(x["kind"] == "object", F.when(some.isNotNull(), total)).otherwise(number)
    return number.try_cast(t.type)


def promote(ingested: DataFrame, targets: tuple[Target, ...] = LOG_LINES, trace: tuple[str, ...] = WATCHED, approved: Registry | None = None) -> DataFrame:
    """Rescued values of ``approved`` paths (or of the target's own) in the typed columns.

    What can't be cast stays rescued. For each field of ``trace`` the columns
    ``<name>__place`` and ``<name>__kind`` say where a line had its value and what
    JSON type that was; both are null where it has none. If several paths have a
    value, the target's own comes first, then the approved in their order.
    """
    ways = {t.name: (t.path, *(approved or {}).get(t.name, ())) for t in targets}
    asked = sorted({p for w in ways.values() for p in w})
    d = ingested.withColumn("_near", F.map_filter("_rescued", lambda k, x: k.isin(*asked)))
    for t in targets:
        found = [F.try_element_at(F.col("_near"), F.lit(p)) for p in ways[t.name]]
        cast = [_replay(x, t) for x in found]
        if t.name in trace:
            own = F.col(t.name).isNotNull()
            place = F.when(own, F.lit(t.path))
            was = F.when(own, F.lit({"long": "integer", "double": "decimal", "string": "string"}[t.type]))
            for p, x in zip(ways[t.name], found, strict=True):
                place = place.when(x["kind"].isNotNull(), F.lit(p))
                was = was.when(x["kind"].isNotNull(), x["kind"])
            d = d.withColumns({f"{t.name}__place": place, f"{t.name}__kind": was})
        d = d.withColumn(t.name, F.coalesce(F.col(t.name), *cast))

    def stays(k: Column, x: Column) -> Column:
        ok = F.lit(False)
        for t in targets:
            for p in ways[t.name]:
                ok = ok | ((k == p) | k.startswith(p + ".")) & F.col(t.name).isNotNull()
        return ~ok

    return d.withColumn("_rescued", F.map_filter("_rescued", stays)).drop("_near")


def file_shapes(promoted: DataFrame, file: str = "file_id", trace: tuple[str, ...] = WATCHED) -> DataFrame:
    """(file, field_name, place, kind): the sets of places and kinds in a file, as text."""
    one = [F.struct(F.lit(n).alias("field_name"), F.col(f"{n}__place").alias("place"), F.col(f"{n}__kind").alias("kind")) for n in trace]
    d = promoted.select(file, F.explode(F.array(*one)).alias("x")).select(file, "x.*").where("kind is not null")
    return d.groupBy(file, "field_name").agg(
        F.array_join(F.array_sort(F.collect_set("place")), " ").alias("place"), F.array_join(F.array_sort(F.collect_set("kind")), " ").alias("kind")
    )


def drift_report(
    shapes: DataFrame, files: DataFrame, file: str = "file_id", stream: str = "stream_id", opened: str = "opened_at", trace: tuple[str, ...] = WATCHED
) -> DataFrame:
    """(file, field_name, change_kind, before, after) against the stream's file before.

    ``change_kind`` is added, removed, renamed or retyped; renamed and retyped may
    both hold. A value that becomes an object under its own name is retyped only.
    The first file of a stream has no change; a file without readable lines has
    no field. Files without stream or opening time aren't compared.
    """
    d = files.select(file, stream, opened).where(F.col(stream).isNotNull() & F.col(opened).isNotNull())
    wide = shapes.groupBy(file).pivot("field_name", list(trace)).agg(F.first(F.struct("place", "kind")))
    d = d.join(wide, file, "left")
    d = Ordered(d, [stream], [opened]).lag(trace).df
    one = [F.struct(F.lit(n).alias("field_name"), F.col(f"prev_{n}").alias("a"), F.col(n).alias("b")) for n in trace]
    d = d.where("_has_prev").select(file, F.explode(F.array(*one)).alias("x")).select(file, "x.*")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    kinds = F.array_compact(
        F.array(
            F.when(F.col("a").isNull() & F.col("b").isNotNull(), F.lit("added")),
            F.when(F.col("a").isNotNull() & F.col("b").isNull(), F.lit("removed")),
            F.when(both & (F.col("a.place") != F.col("b.place")), F.lit("renamed")),
            F.when(both & (F.col("a.kind") != F.col("b.kind")), F.lit("retyped")),
        )
    )
    text = lambda c: F.concat_ws(":", f"{c}.place", f"{c}.kind")
    d = d.withColumn("change_kind", F.explode(kinds))
    return d.select(file, "field_name", "change_kind", text("a").alias("before"), text("b").alias("after"))
