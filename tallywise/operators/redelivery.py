"""Messages delivered more than once: exactly one copy of each is kept.

An exact quotient hash table. The two fixed-width identifiers of a message are
permuted as one 128-bit number; some bits are the quotient, which names a shard, and
all others the remainder, which the shard stores whole. Two entries are equal only
if the identifiers are: there are no false matches at any size.

1. While the input is read, each batch of rows keeps one copy per identifier and
   gives up the others. An identifier that holds much of the data so sends one row a
   batch.
2. What is left is partitioned by quotient, in order of it, and inserted: the table of
   the quotient at hand is all that a task holds, however many copies arrive.

Each row is read once and comes out once, as kept or lost. Tables of batches merge.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the permuted identifier that form the quotient: a shard holds about a millionth of all identifiers.
QUOTIENT_BITS = 20
ENTRY = ["quotient", "rem_hi", "rem_lo", "tag"]
_BLANK = " \t\n\r\f\x0b"
_FIXED = "^[a-z]+_[0-9a-f]{16}$"
_ROUNDS = 4
_U = np.uint64


@dataclass(frozen=True)
class Delivery:
    """Column names: identifiers, and what ranks copies (greatest first, null least); ``row`` is a key."""

    ids: tuple[str, str] = ("message_id", "request_id")
    rank: tuple[str, ...] = ("output_tokens", "batch_id")
    row: str = "row_id"

    @property
    def best(self) -> list[str]:
        """Names of the rank in a table, the row last."""
        return [f"r{i}" for i in range(len(self.rank) + 1)]


def _clean(c: str) -> Column:
    x = F.lower(F.btrim(F.col(c), F.lit(_BLANK)))
    return F.when(x != "", x)


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    """A round function: 64 bits to 64 bits."""
    x = (x ^ _U(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1))) * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def _word(texts: pa.Array) -> np.ndarray:
    """The last 16 characters, hexadecimal digits, as 64 bits."""
    flat = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pc.utf8_slice_codeunits(texts, -16)), "")[0].as_py()
    digits = np.frombuffer(flat.encode(), np.uint8).reshape(-1, 16).astype(_U)
    digits = np.where(digits > 57, digits - _U(87), digits - _U(48))
    return (digits << (_U(60) - np.arange(16, dtype=_U) * _U(4))).sum(1, dtype=_U)


def _entries(b: pa.RecordBatch) -> pa.Table:
    """ENTRY for two columns of cleaned identifiers, then the other columns.

    Identifiers of fixed width (letters, ``_``, 16 hexadecimal digits) are permuted
    whole by a Feistel network, which is invertible whatever its round function, and
    the tag is the two prefixes. Any other identifier keeps its full text as tag; its
    quotient and remainder are only hashes.
    """
    a, c = b.column(0), b.column(1)
    fixed = np.asarray(pc.and_(pc.match_substring_regex(a, _FIXED), pc.match_substring_regex(c, _FIXED)))
    n = len(fixed)
    left, right, tag = np.zeros(n, _U), np.zeros(n, _U), np.empty(n, object)
    if fixed.any():
        x, y = a.filter(pa.array(fixed)), c.filter(pa.array(fixed))
        left[fixed], right[fixed] = _word(x), _word(y)
        heads = pc.binary_join_element_wise(pc.utf8_slice_codeunits(x, 0, -16), pc.utf8_slice_codeunits(y, 0, -16), "\u0001").dictionary_encode()
        tag[fixed] = np.array(heads.dictionary.to_pylist(), object)[heads.indices.to_numpy()]
    for i in np.flatnonzero(~fixed).tolist():
        s, t = a[i].as_py(), c[i].as_py()
        tag[i] = f"{len(s)}\u0001{s}{t}"
        raw = tag[i].encode()
        left[i], right[i] = zlib.crc32(raw) << 32 | zlib.adler32(raw), zlib.crc32(raw[::-1])
    for k in range(_ROUNDS):
        left, right = right, left ^ _mixed(right, k)
    quotient = (left >> _U(64 - QUOTIENT_BITS)).astype(np.int32)
    high = (left & _U((1 << (64 - QUOTIENT_BITS)) - 1)).astype(np.int64)
    cols = [pa.array(quotient), pa.array(high), pa.array(right.view(np.int64)), pa.array(tag, pa.string())]
    return pa.table([*cols, *b.columns[2:]], names=[*ENTRY, *b.schema.names[2:]])


def _one_each(t: pa.Table, best: Sequence[str]) -> tuple[pa.Table, np.ndarray]:
    """``t`` in order of identifier and rank, and where the best copy of each is; its ``n`` is that of all copies. Repeated rows fall away."""
    t = t.combine_chunks()
    code = t.column("tag").combine_chunks().dictionary_encode().indices if t.num_rows else pa.array([], pa.int32())
    keys = [("quotient", "ascending"), ("rem_hi", "ascending"), ("rem_lo", "ascending"), ("_code", "ascending"), *[(c, "descending") for c in best]]
    t = t.append_column("_code", code)
    t = t.take(pc.sort_indices(t, sort_keys=keys, null_placement="at_end"))
    new = np.zeros(t.num_rows, bool)
    for c in ("quotient", "rem_hi", "rem_lo", "_code"):
        v = t.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    new[:1] = True
    start = np.flatnonzero(new)
    n = np.zeros(t.num_rows, np.int64)
    if len(start):
        n[start] = np.add.reduceat(t.column("n").to_numpy(), start)
    winner = start[np.cumsum(new) - 1] if len(start) else start
    row = t.column(best[-1]).combine_chunks()
    again = np.asarray(pc.fill_null(pc.equal(row, row.take(pa.array(winner))), False)) & ~new if len(start) else new
    t = t.drop_columns(["n", "_code"]).append_column("n", pa.array(n))
    return t.filter(pa.array(~again)), new[~again]


def _shape(df: DataFrame, d: Delivery) -> str:
    kinds = [df.schema[c].dataType.simpleString() for c in [*d.rank, d.row]]
    return "quotient int, rem_hi bigint, rem_lo bigint, tag string, " + ", ".join(f"{c} {k}" for c, k in zip(d.best, kinds, strict=True))


def _identified(df: DataFrame, d: Delivery) -> DataFrame:
    a, b = F.col("_a"), F.col("_b")
    x = df.select(_clean(d.ids[0]).alias("_a"), _clean(d.ids[1]).alias("_b"), *[F.col(c).alias(k) for c, k in zip([*d.rank, d.row], d.best, strict=True)])
    return x.where(a.isNotNull() & b.isNotNull())


def with_entry(df: DataFrame, d: Delivery = Delivery()) -> DataFrame:
    """The rows that have both identifiers, as ENTRY, rank (``r0`` ...; the row last).

    Case and surrounding white space don't count; rows with a null or blank
    identifier are left out. Only the named columns are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _entries(b).to_batches()

    return _identified(df, d).mapInArrow(run, _shape(df, d))


def _first_pass(best: Sequence[str], entries: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One copy per identifier and batch; the others are marked lost and get a quotient of their own, so that many copies of one identifier don't meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            t = pa.Table.from_batches([b]) if entries else _entries(b)
            t, won = _one_each(t.append_column("n", pa.array(np.ones(t.num_rows, np.int64))), best)
            spread = (np.arange(seen, seen + t.num_rows) * 40503 & (1 << QUOTIENT_BITS) - 1).astype(np.int32)
            seen += t.num_rows
            quotient = np.where(won, t.column("quotient").to_numpy(), spread)
            t = t.set_column(0, "quotient", pa.array(quotient, pa.int32())).append_column("lost", pa.array(~won))
            yield from t.to_batches()

    return run


def _second_pass(best: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Inserts entries that come in order of quotient into the table of their quotient."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            yield from t.filter(t.column("lost")).to_batches()
            t = t.filter(pc.invert(t.column("lost"))).drop_columns(["lost"])
            t, won = _one_each(pa.concat_tables([table, t]) if table is not None else t, best)
            yield from t.filter(pa.array(~won)).append_column("lost", pa.array(np.ones(int((~won).sum()), bool))).to_batches()
            t = t.filter(pa.array(won))
            open_ = np.asarray(t.column("quotient")) == (t.column("quotient")[-1].as_py() if t.num_rows else -1)
            done, table = t.filter(pa.array(~open_)), t.filter(pa.array(open_))
            yield from done.append_column("lost", pa.array(np.zeros(done.num_rows, bool))).to_batches()
        if table is not None:
            yield from table.append_column("lost", pa.array(np.zeros(table.num_rows, bool))).to_batches()

    return run


def _inserted(first: DataFrame, best: Sequence[str]) -> DataFrame:
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in first.schema.fields)
    return first.repartition("quotient").sortWithinPartitions("quotient").mapInArrow(_second_pass(best), shape)


def resolved(df: DataFrame, d: Delivery = Delivery()) -> DataFrame:
    """Every row that has both identifiers once: ENTRY, rank, ``n`` (of the kept row: all copies) and ``lost``; rows repeated under one row id are one.

    One pass over the input, one shuffle by quotient. ``quotient`` of a lost row means nothing.
    """
    first = _identified(df, d).mapInArrow(_first_pass(d.best, False), f"{_shape(df, d)}, n bigint, lost boolean")
    return _inserted(first, d.best)


def _table(r: DataFrame) -> DataFrame:
    return r.where("not lost").drop("lost")


def insert(df: DataFrame, d: Delivery = Delivery()) -> DataFrame:
    """The table of ``df``: one row per identifier with the rank of its best copy and the number of copies."""
    return _table(resolved(df, d))


def merge(*tables: DataFrame) -> DataFrame:
    """The table of several batches from the tables of each."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    best = [c for c in out.columns if c not in (*ENTRY, "n")]
    return _table(_inserted(out.withColumn("lost", F.lit(False)), best))


def dropped(df: DataFrame, d: Delivery = Delivery(), table: DataFrame | None = None) -> DataFrame:
    """(row) of each copy that isn't kept.

    The greatest rank stays (null is least), among equals the greatest row id. Rows
    without both identifiers are never dropped. Rows repeated under one row id
    are one copy. With the ``table`` of earlier batches, copies kept there compete too,
    and come out if ``df`` has a better one.
    """
    r = resolved(df, d)
    if table is not None:
        r = r.where("lost").unionByName(_inserted(_table(r).unionByName(table).withColumn("lost", F.lit(False)), d.best))
    return r.where("lost").select(F.col(d.best[-1]).alias(d.row)).distinct()


def keep_one(df: DataFrame, d: Delivery = Delivery()) -> DataFrame:
    """``df`` without the dropped copies."""
    return df.join(dropped(df, d), d.row, "left_anti")
