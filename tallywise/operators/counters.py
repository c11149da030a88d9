"""Totals of cumulative counters that start again, in one scan over rows of any session length.

Rows are range-partitioned on (session, order) and sorted. Each partition is scanned
once as if nothing came before it; what its first session brings over from earlier
partitions is a state of a dozen numbers, put together from one or two summary rows a
partition and added to that session's rows afterwards. A session of any size is
spread over as many partitions as its rows need.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.plans.scale import materialise

#: Thresholds of a reset; fixed values.
COST_STEP, MS_STEP = 1e-4, 100
#: Kinds of rows: a mark comes before rows of its time; summaries are of a partition's first and last session.
MARK, ROW, FIRST, LAST = 0, 1, 2, 3
_HELD = ("_seg", "_first", "_top", "_closed", "_more")


@dataclass
class State:
    """Where a session stands: its segment from 0, tops of that segment, totals of those before, and its last cost and duration."""

    session: object
    seg: int
    top: np.ndarray
    closed: np.ndarray
    last: np.ndarray


def falls(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Whether cost or duration (the last axis) fell, from a row that had some."""
    had = (before[..., 0] > COST_STEP) | (before[..., 1] > MS_STEP)
    return had & ((now[..., 0] < before[..., 0] - COST_STEP) | (now[..., 1] + MS_STEP < before[..., 1]))


def scan_rows(session: np.ndarray, x: np.ndarray, state: State | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, tops, totals of the session's segments before) of rows in order; ``state`` is that before them. The first columns of ``x`` are cost and duration."""
    new = np.append(True, session[1:] != session[:-1])
    new[0] = state is None or session[0] != state.session
    before = np.vstack([x[:1, :2] if state is None else state.last, x[:-1, :2]])
    cut = new | falls(before, x[:, :2])
    part = np.cumsum(cut)
    top = pd.DataFrame(np.maximum(x, 0)).groupby(part).cummax().to_numpy()
    if not cut[0]:
        top[part == 0] = np.maximum(top[part == 0], state.top)
    # Parts of the rows that are one segment; part 0 is the segment that was open before, with rows here or without.
    starts = np.flatnonzero(cut)
    tops = np.zeros((len(starts) + 1, x.shape[1]))
    tops[1:] = top[np.append(starts[1:], len(x)) - 1] if len(starts) else tops[1:]
    if state is not None:
        tops[0] = state.top if cut[0] else top[(starts[0] if len(starts) else len(x)) - 1]
    owner = np.cumsum(np.append(False, new[starts]))
    closed = pd.DataFrame(tops).groupby(owner).cumsum().groupby(owner).shift(1, fill_value=0.0).to_numpy()
    number = pd.Series(owner).groupby(owner).cumcount().to_numpy()
    if state is not None:
        closed[owner == 0] += state.closed
        number[owner == 0] += state.seg
    return number[part], top, closed[part]


def _partition(counters: int, names: Sequence[str]):
    """Scans one partition; columns are session, kind, the partition, the counters, and others that pass through."""

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))

    def summary(schema: pa.Schema, kind: int, pid: int, s: State, more: list[float] | None) -> pa.RecordBatch:
        held = {names[0]: s.session, "_kind": kind, "_pid": pid, "_seg": s.seg, "_first": True, "_top": s.top, "_closed": s.closed, "_more": more}
        return pa.RecordBatch.from_arrays([pa.array([held.get(f.name)], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: State | None = None
        first: State | None = None
        opening, head, top0, pid, schema = None, None, np.zeros(counters), 0, None
        for b in batches:
            if not b.num_rows:
                continue
            session = np.array(b.column(0).to_pylist(), object)
            if schema is None:
                opening, pid = session[0], b.column(2)[0].as_py()
                first = State(opening, None, np.zeros(counters), np.zeros(counters), np.zeros(2))
            n, before = b.num_rows, state
            row = b.column(1).to_numpy() == ROW
            seg, top, closed, known = np.zeros(n, np.int64), np.zeros((n, counters)), np.zeros((n, counters)), np.zeros(n, bool)
            at = np.cumsum(row) - 1
            if row.any():
                x = np.column_stack([b.column(3 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(counters)])[row]
                who = session[row]
                s, t, c = scan_rows(who, x, before)
                state = State(who[-1], int(s[-1]), t[-1], c[-1], x[-1, :2])
                mine = np.flatnonzero(who == opening)
                if len(mine):
                    head = x[mine[0], :2] if head is None else head
                    zero = mine[s[mine] == 0]
                    top0 = t[zero[-1]] if len(zero) else top0
                    first = State(opening, int(s[mine[-1]]), t[mine[-1]], c[mine[-1]], x[mine[-1], :2])
                here = at >= 0
                here[here] = session[here] == who[at[here]]
                seg[here], top[here], closed[here], known[here] = s[at[here]], t[at[here]], c[at[here]], True
            if before is not None:
                early = (at < 0) & (session == before.session)
                seg[early], top[early], closed[early], known[early] = before.seg, before.top, before.closed, True
            cols = [pa.array(seg, mask=~known), pa.array(session == opening), lists(top), lists(closed), pa.nulls(n, pa.list_(pa.float64()))]
            out = pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *_HELD])
            schema = out.schema
            yield out
        if schema is not None:
            yield summary(schema, FIRST, pid, first, None if head is None else [*head, *top0])
            if state is not None:
                yield summary(schema, LAST, pid, state, [*state.last])

    return run


def carried(parts: Sequence[Mapping], counters: int) -> list[tuple]:
    """(partition, segments to add, totals to add, top to go on with, what later segments gain) of each partition whose first session came before.

    ``parts`` are summary rows; the state of the rows before goes from partition to partition.
    """
    by: dict[int, dict[int, Mapping]] = {}
    for r in parts:
        by.setdefault(r["_pid"], {})[r["_kind"]] = r
    out: list[tuple] = []
    state: State | None = None
    for pid in sorted(by):
        first, last = by[pid][FIRST], by[pid].get(LAST)
        comes = state is not None and state.session == first["session"]
        segs, add, go, gain = 0, np.zeros(counters), None, np.zeros(counters)
        if comes:
            segs, add, go = state.seg, state.closed, state.top
            if first["_more"] is not None:
                more = np.array(first["_more"])
                if falls(state.last, more[:2]):
                    segs, add, go = segs + 1, add + state.top, None
                else:
                    gain = np.maximum(state.top, more[2:]) - more[2:]
            out.append((pid, segs, add.tolist(), None if go is None else go.tolist(), gain.tolist()))
        if last is not None:
            seg, top, closed = last["_seg"], np.array(last["_top"]), np.array(last["_closed"])
            if comes and last["session"] == first["session"]:
                top = np.maximum(go, top) if go is not None and seg == 0 else top
                closed = add + closed + (gain if seg else 0.0)
                seg += segs
            state = State(last["session"], seg, top, closed, np.array(last["_more"]))
    return out


def scan(df: DataFrame, session: str, order: Sequence[str], counters: Sequence[str], kind: str | None = None) -> DataFrame:
    """``df`` with ``segment`` from 1 and ``cum_<counter>``: the total up to the row, over all segments so far.

    ``order`` puts the rows of a session in order. Rows whose ``kind`` is MARK have no
    counters; they get the totals of the last row before them, null if there is none.
    The first two counters are cost and duration. Session and counters must not be null
    in rows. The input is shuffled once and read twice.
    """
    kept = [c for c in df.columns if c not in (session, *counters, kind)]
    d = df.select(
        F.col(session), (F.col(kind).cast("int") if kind else F.lit(ROW)).alias("_kind"), F.lit(0).alias("_pid"), *[F.col(c) for c in counters], *[F.col(c) for c in kept]
    )
    by = [session, *(o if o != kind else "_kind" for o in order)]
    d = d.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_pid", F.spark_partition_id())
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields)
    d = materialise(d.mapInArrow(_partition(len(counters), d.columns), f"{head}, _seg bigint, _first boolean, _top array<double>, _closed array<double>, _more array<double>"))
    parts = d.where(F.col("_kind") >= FIRST).select(F.col(session).alias("session"), "_kind", "_pid", "_seg", "_top", "_closed", "_more").collect()  # at most two rows a partition
    shape = "_cp int, _segs bigint, _add array<double>, _go array<double>, _gain array<double>"
    carry = df.sparkSession.createDataFrame(carried([r.asDict() for r in parts], len(counters)), shape)
    j = d.where(F.col("_kind") <= ROW).join(F.broadcast(carry), (F.col("_pid") == F.col("_cp")) & F.col("_first"), "left")
    seg, out = F.col("_seg"), {}
    for i, c in enumerate(counters):
        at = lambda x, i=i: F.get(F.col(x), F.lit(i))
        own = at("_closed") + at("_top")
        later = F.when(seg.isNull(), F.coalesce(at("_go"), F.lit(0.0))).when((seg == 0) & F.col("_go").isNotNull(), F.greatest(at("_go"), at("_top"))).otherwise(at("_gain") + own)
        out[f"cum_{c}"] = F.when(F.col("_cp").isNotNull(), at("_add") + later).when(seg.isNotNull(), own).cast(df.schema[c].dataType)
    # Marks before the reset with which a partition begins are in the segment before it.
    early = F.when(seg.isNull() & F.col("_cp").isNotNull() & F.col("_go").isNull(), 1).otherwise(0)
    j = j.withColumns({**out, "segment": F.coalesce("_seg", F.lit(0)) + F.coalesce("_segs", F.lit(0)) + 1 - early})
    return (j.withColumnRenamed("_kind", kind) if kind else j).select(*df.columns, "segment", *out)
