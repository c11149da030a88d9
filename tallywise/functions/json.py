"""Strict reading of JSON lines: a line counts only if its fields have the types that they must have.

Lines are parsed by Python's decoder in Arrow batches, which takes a small part of the
time that typed extraction from VARIANT values takes for as many fields.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LONG = 1 << 63


def kind(x: object) -> str | None:
    """integer (of 64 bits), decimal, too large (a number beyond doubles), string, object, array or boolean; None for null and nothing."""
    if isinstance(x, str):
        return "string"
    if isinstance(x, bool):
        return "boolean"
    if isinstance(x, int):
        return "integer" if -_LONG <= x < _LONG else "decimal"
    if isinstance(x, float):
        return "decimal" if math.isfinite(x) else "too large"
    return {dict: "object", list: "array"}.get(type(x))


def refuse(name: str) -> None:
    """For NaN and Infinity, which aren't JSON."""
    raise ValueError(name)


def _once(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a name comes twice")
    return out


_DECODER = json.JSONDecoder(parse_constant=refuse, object_pairs_hook=_once)
_ABSENT = object()


def plain(text: str) -> str:
    """Characters that UTF-8 doesn't have as escapes."""
    return text if text.isascii() else text.encode("utf-8", "backslashreplace").decode()


def parse(body: str | None) -> dict | None:
    """The object that a line is; None if it is none or a name comes twice in an object."""
    try:
        x = _DECODER.decode(body) if body else None
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


@dataclass(frozen=True)
class Field:
    """What a field must be: one of ``kinds``; ``need`` asks for a value; ``null`` allows null where the field may be absent; ``count`` asks for at least 0."""

    path: str
    kinds: tuple[str, ...]
    need: bool = False
    null: bool = True
    count: bool = False


def get(x: object, keys: Sequence[str]) -> object:
    """The value under a path, or _ABSENT."""
    for k in keys:
        if not isinstance(x, dict) or k not in x:
            return _ABSENT
        x = x[k]
    return x


def value(x: object, path: str) -> object:
    """The value under a path; None if there is none."""
    v = get(x, path.split("."))
    return None if v is _ABSENT else v


def fits(x: dict, fields: Sequence[tuple[Field, tuple[str, ...]]]) -> bool:
    """Whether an object has all fields (with their split paths) as they must be."""
    for f, keys in fields:
        v = get(x, keys)
        if v is _ABSENT or v is None:
            if f.need or (v is None and not f.null):
                return False
        elif kind(v) not in f.kinds or (f.count and not 0 <= v < _LONG):
            return False
    return True


def read(lines: DataFrame, fields: Sequence[Field], row: Callable[[dict], Sequence], names: Sequence[str], shape: str, body: str = "body", check: Callable[[dict], bool] | None = None, all_lines: bool = False) -> DataFrame:
    """``lines`` without ``body``, with what ``row`` gives for each line that fits; with ``all_lines`` the others too, with ``ok`` false and nulls.

    ``shape`` has the types of ``names``.
    """
    keep = [c for c in lines.columns if c != body]
    types = pa.schema([pa.field(n, t) for n, t in zip(names, _types(shape), strict=True)])
    split = [(f, tuple(f.path.split("."))) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                x = parse(text)
                good = x is not None and fits(x, split) and (check is None or check(x))
                if good or all_lines:
                    at.append(i)
                    rows.append((*([good] if all_lines else []), *(row(x) if good else [None] * len(names))))
            cols = list(zip(*rows, strict=True)) if rows else [()] * (len(names) + all_lines)
            ok = [pa.array(cols[0], pa.bool_())] if all_lines else []
            got = [pa.array(c, t) for c, t in zip(cols[1:] if all_lines else cols, types.types, strict=True)]
            few = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*few.columns[:-1], *ok, *got], names=[*keep, *(["ok"] if all_lines else []), *names])

    first = lines.select(*[F.col(c) for c in keep], F.col(body).alias("_body"))
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in first.schema.fields[:-1])
    return first.mapInArrow(run, f"{head}{'ok boolean, ' if all_lines else ''}{shape}")


def _types(shape: str) -> list[pa.DataType]:
    known = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
    return [known[x.strip().split(" ", 1)[1]] for x in shape.split(",")]


def text(v: object) -> str | None:
    """A text, or a number as text."""
    return None if v is None else plain(v) if isinstance(v, str) else repr(v)
