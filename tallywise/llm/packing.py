"""Filling fixed-capacity containers with items: a configuration linear program.

The histogram of lengths, at most one count per length up to the capacity, is all
that reaches the driver. There

1. lengths are grouped into classes of about equal volume; those of a small part
   of the capacity are one class that counts in tokens, since they fill any room,
2. the configuration LP (fewest containers that cover every class) is solved by
   multiplicative weights; a knapsack dynamic program prices configurations,
3. the solution is rounded down to whole containers and given exact lengths,
4. what the rounding left is placed best-fit into the room.

Containers of equal content are one run with a multiplicity throughout, so the
work on the driver depends on the capacity, not on the number of items.
"""

from __future__ import annotations

import warnings
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywise.plans.scale import join_checked, materialise

CAPACITY = 2_048
#: Classes of the LP, and the share of the capacity up to which lengths are the class that counts in tokens.
CLASSES, SMALL = 64, 1 / 8
#: The gap between the solution and the dual bound at which the LP ends, steps of a round, step size, the most rounds, after which
#: the gap reached is reported, and the rounds without gain after which steps are halved.
GAP, STEPS, RATE, ROUNDS, PATIENCE, FLOOR = 0.005, 200, 20.0, 600, 60, 0.02
#: Shares of the LP's containers that rounding keeps; the rest of the items is placed best-fit, and the share that needs the fewest
#: containers is taken, the greatest among equals.
PARTS = (1.0, 0.75, 0.5, 0.3)
#: Rows of one length that are ranked in one group.
RANK_ROWS = 200_000


def price(sizes: np.ndarray, values: np.ndarray, capacity: int, most: np.ndarray, rest: float = 0.0) -> tuple[float, np.ndarray]:
    """Knapsack: (value, count of each size) of the dearest configuration.

    A size may be taken up to ``most`` times; powers of two of it are the items of
    the dynamic program. Each token of room that is left is worth ``rest``.
    """
    best = np.zeros(capacity + 1)
    taken = []
    for j in np.argsort(-sizes, kind="stable"):
        left, m = int(min(most[j], capacity // sizes[j])), 1
        while left > 0:
            k = min(m, left)
            w = int(sizes[j]) * k
            if w > capacity:
                break
            new = best[:-w] + values[j] * k
            better = new > best[w:] + 1e-15
            if better.any():
                taken.append((j, k, w, better))
                best[w:][better] = new[better]
            left -= k
            m *= 2
    best = best + rest * np.arange(capacity, -1, -1)
    out, at = np.zeros(len(sizes), np.int64), int(best.argmax())
    value = float(best[at])
    for j, k, w, better in reversed(taken):
        if at >= w and better[at - w]:
            out[j] += k
            at -= w
    return value, out


@dataclass
class LP:
    """A fractional solution: configurations (class counts), how often each, and bounds of the number of containers."""

    configs: list[np.ndarray]
    times: np.ndarray
    upper: float
    lower: float
    iterations: int

    @property
    def gap(self) -> float:
        return self.upper / self.lower - 1 if self.lower else 0.0


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int, fluid: int = 0, gap: float = GAP, rounds: int = ROUNDS) -> LP:
    """min sum x over configurations that cover ``counts``, and ``fluid`` tokens in what room they leave, by multiplicative weights.

    Classes and known configurations play a matrix game: weights of classes fall and
    those of configurations rise by how well they are covered and cover, each step
    corrected by the one before. After every round of steps the dearest configuration
    under the classes' mean weights is priced; it gives the dual bound, and joins the
    known ones. Ends when the solution is within ``gap`` of the bound.
    """
    n = np.append(counts, fluid).astype(float) if fluid else counts.astype(float)
    known: dict[bytes, np.ndarray] = {}

    def add(c: np.ndarray) -> None:
        room = capacity - int(c @ sizes)
        known.setdefault(c.tobytes(), (np.append(c, min(room, fluid)) if fluid else c) / n)

    for j in range(len(sizes)):
        c = np.zeros(len(sizes), np.int64)
        c[j] = min(capacity // sizes[j], counts[j])
        add(c)
    if fluid:
        add(np.zeros(len(sizes), np.int64))
    lower, upper, t = 0.0, np.inf, 0
    y, x = np.full(len(n), 1 / len(n)), np.full(len(known), 1 / len(known))
    best: np.ndarray = x
    rate, stuck, mark = RATE, 0, np.inf
    for t in range(1, rounds + 1):
        a = np.array(list(known.values())).T
        # No weight dies out: each round begins with a little of everything.
        x = np.append(x, np.full(a.shape[1] - len(x), 1 / a.shape[1]))
        x, y = (1 - FLOOR) * x / x.sum() + FLOOR / len(x), (1 - FLOOR) * y + FLOOR / len(y)
        top = rate / a.max()
        got, worth = a @ x, a.T @ y
        ys, xs = np.zeros(len(y)), np.zeros(len(x))
        for _ in range(STEPS):
            got0, worth0, got, worth = got, worth, a @ x, a.T @ y
            y = y * np.exp(-top * (2 * got - got0))
            y /= y.sum()
            x = x * np.exp(top * (2 * worth - worth0))
            x /= x.sum()
            ys += y
            xs += x
        ys /= ys.sum()
        xs /= xs.sum()
        low = float((a @ xs).min())
        if low > 0 and 1 / low < upper:
            upper, best = 1 / low, xs / low
        for w in (ys, y):
            each = w / n
            value, c = price(sizes, each[: len(sizes)], capacity, counts, each[-1] if fluid else 0.0)
            lower = max(lower, 1 / value)
            add(c)
        if upper <= lower * (1 + gap):
            break
        # Shorter steps where long ones no longer help.
        now = upper / lower
        mark, stuck = (now, 0) if now < mark * (1 - 1e-3) else (mark, stuck + 1)
        if stuck == PATIENCE:
            rate, stuck = rate / 2, 0
    keys = list(known)[: len(best)]
    return LP([np.frombuffer(k, np.int64) for k in keys], best, upper, lower, t)


@dataclass
class Packing:
    """Runs of equal containers; ``runs[i]`` is (multiplicity, {length: count})."""

    capacity: int
    runs: list[tuple[int, dict[int, int]]] = field(default_factory=list)
    #: No packing has fewer containers: the greater of the LP's dual bound for these classes' least lengths and the volume.
    bound: int = 0
    #: Gap between the LP's solution and its dual bound, and whether it is as small as asked for.
    gap: float = 0.0
    converged: bool = True
    #: The share of the LP's containers that was kept in rounding.
    part: float = 0.0

    @property
    def containers(self) -> int:
        return sum(m for m, _ in self.runs)

    def slots(self) -> np.ndarray:
        """Rows (length, first rank, containers' base, items of the length in each), sorted by length and rank."""
        rows, base, at = [], 0, defaultdict(int)
        for m, inside in self.runs:
            for size, k in inside.items():
                rows.append((size, at[size], base, k))
                at[size] += m * k
            base += m
        return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack_histogram(hist: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES, small: float = SMALL, gap: float = GAP, rounds: int = ROUNDS) -> Packing:
    """Containers for ``hist[length]`` items of each length (1 to ``capacity``). All lengths are in the LP."""
    left = np.zeros(capacity + 1, np.int64)
    for size, k in hist.items():
        if not 0 < size <= capacity:
            raise ValueError(f"length {size} is outside 1..{capacity}")
        left[size] += k
    volume = int(left @ np.arange(capacity + 1))
    room: dict[int, list] = defaultdict(list)  # free space -> runs [multiplicity, content]
    full = int(left[capacity])
    if full:
        room[0].append([full, {capacity: 1}])
        left[capacity] = 0
    has = np.flatnonzero(left)
    big = has[has > capacity * small]
    fluid = int(sum(int(s) * int(left[s]) for s in has if s <= capacity * small))
    out = Packing(capacity)
    if len(big):
        cum = np.cumsum(left[big] * big)
        group = np.minimum((cum - 1) * classes // cum[-1], classes - 1)
        _, group = np.unique(group, return_inverse=True)
        members = [big[group == g] for g in range(group.max() + 1)]
        counts = np.array([left[m].sum() for m in members])
        lp = solve(np.array([m.max() for m in members]), counts, capacity, fluid, gap, rounds)
        out.gap, out.converged = lp.gap, lp.gap <= gap
        if not out.converged:
            warnings.warn(f"the configuration program ended {lp.gap:.3f} from its bound after {lp.iterations} rounds", stacklevel=2)
        # Lengths rounded down to the least of their class can't need more containers than the lengths themselves.
        out.bound = full + int(np.ceil(_dual(np.array([m.min() for m in members]), counts, capacity, fluid) - 1e-6))
    out.bound = max(out.bound, -(-volume // capacity))
    for part in PARTS if len(big) else (1.0,):
        rest, now = left.copy(), defaultdict(list, {s: [[m, dict(x)] for m, x in runs] for s, runs in room.items()})
        for c in np.argsort(-lp.times, kind="stable") if len(big) else ():
            _realise(lp.configs[c], int(lp.times[c] * part + 1e-9), members, rest, now, capacity)
        _best_fit(rest, now, capacity)
        runs = [(m, x) for s in sorted(now) for m, x in now[s] if m]
        if not out.runs or sum(m for m, _ in runs) < out.containers:
            out.runs, out.part = runs, part
    return out


def _dual(sizes: np.ndarray, counts: np.ndarray, capacity: int, fluid: int) -> float:
    """A lower bound of the LP for these sizes."""
    return solve(sizes, counts, capacity, fluid).lower


def _realise(config: np.ndarray, times: int, members: list[np.ndarray], left: np.ndarray, room: dict, capacity: int) -> None:
    """Up to ``times`` containers of a configuration, with lengths from its classes, as runs."""
    for j in np.flatnonzero(config):
        times = min(times, int(left[members[j]].sum()) // int(config[j]))
    if times <= 0 or not config.any():
        return
    # Each place in the configuration is a list of lengths, one per container; runs end where any list changes.
    places = []
    for j in np.flatnonzero(config):
        sizes = members[j][::-1]
        need = times * int(config[j])
        take = np.minimum(left[sizes], np.maximum(0, need - (np.cumsum(left[sizes]) - left[sizes])))
        left[sizes] -= take
        sizes, ends = sizes[take > 0], np.cumsum(take[take > 0])
        for r in range(int(config[j])):
            a, b = r * times, (r + 1) * times
            i, k = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left")
            cut = np.minimum(ends[i : k + 1], b) - a
            got = sizes[i : k + 1]
            if r % 2:  # long ones meet short ones
                cut, got = np.cumsum(np.diff(np.concatenate([[0], cut]))[::-1]), got[::-1]
            places.append((cut, got))
    marks = np.unique(np.concatenate([c for c, _ in places]))
    start = 0
    for m in marks.tolist():
        inside: dict[int, int] = defaultdict(int)
        for cut, got in places:
            inside[int(got[np.searchsorted(cut, start, "right")])] += 1
        room[capacity - sum(s * k for s, k in inside.items())].append([m - start, dict(inside)])
        start = m


def _best_fit(left: np.ndarray, room: dict, capacity: int) -> None:
    """Places all that is left, longest first, where it fits best; opens runs of containers when nothing fits."""
    has = np.zeros(capacity + 1, bool)
    for s, runs in room.items():
        has[s] = bool(runs)
    for size in np.flatnonzero(left)[::-1].tolist():
        n = int(left[size])
        while n:
            fits = np.flatnonzero(has[size:])
            if len(fits):
                s = size + int(fits[0])
                m, inside = room[s].pop()
                each = min(s // size, max(1, n // m))
                k = min(m, n // each)
                if k < m:
                    room[s].append([m - k, inside])
                n -= k * each
            else:
                s, inside = capacity, {}
                each = min(capacity // size, n)
                k = n // each
                n -= k * each
            has[s] = bool(room[s])
            new = dict(inside)
            new[size] = new.get(size, 0) + each
            room[s - size * each].append([k, new])
            has[s - size * each] = True
        left[size] = 0


def pieces(lengths: DataFrame, key: str, n: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """(key, n, piece, start, size): an item over the capacity in full pieces and a rest, others whole."""
    full = (F.col(n) / capacity).cast("long") - F.when((F.col(n) % capacity == 0) & (F.col(n) > 0), 1).otherwise(0)
    d = lengths.select(key, n, F.explode(F.sequence(F.lit(0), full)).alias("piece"))
    start = F.col("piece") * capacity
    return d.select(key, n, F.col("piece").cast("int"), start.alias("start"), F.least(F.lit(capacity), F.col(n) - start).cast("int").alias("size"))


def ranked(p: DataFrame, key: str) -> DataFrame:
    """``p`` with ``rank`` from 0 among pieces of a size.

    A size of any number of rows is spread over hash salts; each salt is ranked by
    itself and starts after the counts of the salts before it.
    """
    salts = max(8, -(-p.count() // RANK_ROWS))
    p = p.withColumn("_salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).cast("int"))
    count = p.groupBy("size", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    offset = count.select("size", "_salt", F.coalesce(before, F.lit(0)).alias("_offset"))
    p = p.withColumn("_rn", F.row_number().over(Window.partitionBy("size", "_salt").orderBy(key, "piece")))
    p = join_checked(p, materialise(offset), ["size", "_salt"])
    return p.withColumn("rank", F.col("_offset") + F.col("_rn") - 1).drop("_salt", "_rn", "_offset")


def fill(lengths: DataFrame, key: str, n: str = "n_tokens", capacity: int = CAPACITY) -> tuple[DataFrame, Packing]:
    """(key, n, piece, start, size, container) for every item, and the packing.

    Items up to the capacity have one piece in one container; longer ones are cut
    into full pieces and a rest. No container holds more than the capacity. An item
    of length 0 or null takes no room; such items are dealt out over the containers
    in turn (to container 0 if there is no other). Rows may repeat; each is an item.
    """
    d = lengths.select(F.col(key).alias("_key"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("_n"))
    d = materialise(d)
    p = pieces(d, "_key", "_n", capacity)
    hist = {r["size"]: r["count"] for r in p.where("size > 0").groupBy("size").count().collect()}  # at most one row per length
    packing = pack_histogram(hist, capacity)
    out = ranked(p, "_key")
    shared = lengths.sparkSession.sparkContext.broadcast((packing.slots(), max(1, packing.containers)))
    names = [key, n, "piece", "start", "size", "container"]
    kind = lengths.schema[key].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, containers = shared.value
        first = (slots[:, 0] << 44) + slots[:, 1]
        for b in batches:
            size, rank = b.column("size").to_numpy().astype(np.int64), b.column("rank").to_numpy().astype(np.int64)
            if len(first):
                row = np.maximum(np.searchsorted(first, (size << 44) + rank, "right") - 1, 0)
                at = slots[row, 2] + (rank - slots[row, 1]) // slots[row, 3]
                at = np.where(size > 0, at, rank % containers)
            else:
                at = rank % containers
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(at)], names=names)

    cols = out.select("_key", "_n", "piece", "start", "size", "rank")
    schema = f"`{key}` {kind}, `{n}` bigint, piece int, start bigint, size int, container bigint"
    return cols.mapInArrow(place, schema), packing
