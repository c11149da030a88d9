"""Evaluation texts leaking into training text: spaced-seed hashing.

A seed is a window of SPAN words of which a fixed mask ignores some. Hashes of
the seeds of all test items are joined with those of every window of every
document, and around each hit the two texts are compared word by word along the
diagonal, so that overlaps are verified and may contain substitutions.

Masks begin and end with a word that counts and are no longer than the shortest
run searched, so every exact run of SPAN words is hit by every mask. Together with
the seed RUN they hit every overlap that :func:`overlap` accepts: its runs up to the
one with which it reaches SPAN words can lie in 2,832 ways, and a seed fits into each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.llm.markup import words
from tallywise.plans.scale import materialise

SPAN = 13
#: Word positions that count; fixed, for this SPAN, SIMILARITY and GAP.
MASKS = ("1100100100011", "1001010011001", "1011001001001", "1010011010001")
#: For overlaps in which no window of SPAN words begins and ends with equal words.
RUN = "1" * 9
#: Least share of equal words in a tolerant overlap.
SIMILARITY = 0.8
#: Most mismatches in a row inside an overlap.
GAP = 2
#: Most characters of test items whose seeds and words every task holds. The seeds of more items are joined by shuffle.
HELD_CHARS = 19_000_000
#: Bits of the filter of the shuffled join for each seed of the items, and at most (2 ** 30 are 128 MB). Up to there about one window
#: in 80,000 passes by chance; beyond, more windows are joined, with the same result.
SEED_BITS, MOST_BITS = 64, 30
_FILTER_BITS = 22


def _mixers(n: int) -> np.ndarray:
    """Odd multipliers, from a fixed seed."""
    return np.random.default_rng(13).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def seeds(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the windows whose counting words are all known (id > 0)."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, ok = np.zeros(n, np.uint64), np.ones(n, bool)
    wide = ids.astype(np.uint64)
    for k, (c, m) in enumerate(zip(mask, _mixers(len(mask)), strict=True)):
        if c == "1":
            h += wide[k : k + n] * m
            ok &= ids[k : k + n] > 0
    at = np.flatnonzero(ok)
    h = h[at]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return at, h


class ItemIndex:
    """The words and sorted seed hashes of test items."""

    def __init__(self, rows: list[tuple[object, str | None]]):
        self.vocab: dict[str, int] = {}
        self.keys: list[object] = []
        parts, self.start = [], []
        pad, at = np.zeros(SPAN, np.int32), 0
        for key, text in rows:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)], np.int32)
            self.keys.append(key)
            self.start.append(at)
            parts += [ids, pad]
            at += len(ids) + SPAN
        self.ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.start = np.array(self.start, np.int64)
        self.hash, self.pos, self.filter = [], [], []
        for mask in (*MASKS, RUN):
            p, h = seeds(self.ids, mask)
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[h >> np.uint64(64 - _FILTER_BITS)] = True
            self.hash.append(h[order])
            self.pos.append(p[order])
            self.filter.append(bits)

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int, int, int]]:
        """(text, item, text word, item word, words, substitutions, longest exact run): the best overlap of each pair."""
        get = self.vocab.get
        parts, start, at = [], np.zeros(len(texts), np.int64), 0
        pad = [0] * SPAN
        flat: list[int] = []
        for i, t in enumerate(texts):
            start[i] = at
            flat += [get(w, 0) for w in words(t)]
            flat += pad
            at = len(flat)
        ids = np.array(flat, np.int32)
        pairs = []
        for mask, table, pos, bits in zip((*MASKS, RUN), self.hash, self.pos, self.filter, strict=True):
            p, h = seeds(ids, mask)
            hit = bits[h >> np.uint64(64 - _FILTER_BITS)]
            p, h = p[hit], h[hit]
            lo, hi = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
            n = hi - lo
            p, lo, n = p[n > 0], lo[n > 0], n[n > 0]
            q = pos[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())] if len(n) else np.zeros(0, np.int64)
            pairs.append(np.stack([np.repeat(p, n), q]))
        p, q = np.concatenate(pairs, axis=1)
        if not len(p):
            return
        doc, item = np.searchsorted(start, p, "right") - 1, np.searchsorted(self.start, q, "right") - 1
        diag = np.unique(np.stack([doc, item, p - q]), axis=1)
        best: dict[tuple[int, int], tuple] = {}
        ends = np.append(self.start[1:], len(self.ids))
        for d, i, off in diag.T.tolist():
            a, b = max(int(self.start[i]), int(start[d]) - off), min(int(ends[i]) - SPAN, (int(start[d + 1]) if d + 1 < len(start) else len(ids)) - SPAN - off)
            found = overlap(ids[a + off : b + off] == self.ids[a:b])
            if found:
                at, size, wrong, run = found
                row = (d, i, a + off + at - int(start[d]), a + at - int(self.start[i]), size, wrong, run)
                old = best.get((d, i))
                if old is None or (row[6], row[4], -row[2], -row[3]) > (old[6], old[4], -old[2], -old[3]):
                    best[d, i] = row
        yield from best.values()


def overlap(same: np.ndarray) -> tuple[int, int, int, int] | None:
    """(start, words, substitutions, longest run of equal words) of the best overlap on a diagonal.

    Runs of equal words join over gaps of up to GAP words while SIMILARITY holds.
    None if it is shorter than SPAN words. The overlap with the longest exact run
    wins, then the longer, then the first.
    """
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    best = None
    cur: list[int] | None = None
    for s, e in edge.reshape(-1, 2).tolist():
        if cur and s - cur[1] <= GAP and (cur[2] + e - s) >= SIMILARITY * (e - cur[0]):
            cur = [cur[0], e, cur[2] + e - s, max(cur[3], e - s)]
        else:
            cur = [s, e, e - s, e - s]
        if cur[1] - cur[0] >= SPAN and (best is None or (cur[3], cur[1] - cur[0]) > (best[3], best[1] - best[0])):
            best = list(cur)
    return None if best is None else (best[0], best[1] - best[0], best[1] - best[0] - best[2], best[3])


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, doc, doc_word, item_word, words, substitutions, exact_run): each pair with an overlap of SPAN words or more.

    One row per pair and document row, with its best overlap among all that
    :func:`overlap` accepts on any diagonal; positions are in words from 0. Case, punctuation, markup, quote marks, invisible characters and
    line layout don't count. Null and empty texts, and items of fewer than SPAN
    words, give no row. Item keys may repeat; each item is searched by itself.

    Documents are read once, whatever the number of items. Up to HELD_CHARS of items
    are held by every task and nothing is shuffled; beyond, see :func:`leaks_joined`.
    """
    spark = docs.sparkSession
    chars = items.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()[0]
    if chars > HELD_CHARS:
        return leaks_joined(docs, items, doc, text, item, item_text)
    schema = _schema(docs, items, doc, item)
    shared = spark.sparkContext.broadcast(ItemIndex([tuple(r) for r in items.select(item, item_text).collect()]))
    return docs.select(F.col(doc).alias("d"), F.col(text).alias("t")).mapInArrow(_search(shared, schema), schema)


def _schema(docs: DataFrame, items: DataFrame, doc: str, item: str) -> str:
    return f"{item} {items.schema[item].dataType.simpleString()}, {doc} {docs.schema[doc].dataType.simpleString()}, doc_word int, item_word int, words int, substitutions int, exact_run int"


def _hashes(text: str | None, known: dict[str, int]) -> np.ndarray:
    """64 bits for each word, never 0; ``known`` is emptied when it has grown large."""
    if len(known) > 1_000_000:
        known.clear()
    out = []
    for w in words(text):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w) | 1
        out.append(h)
    return np.array(out, np.uint64)


def _all_seeds(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) under every mask; masks don't share hashes."""
    found = [seeds(ids, m) for m in (*MASKS, RUN)]
    turn = [h ^ np.uint64(k * 0x9E3779B97F4A7C15 & 2**64 - 1) for k, (_, h) in enumerate(found, 1)]
    return np.concatenate([p for p, _ in found]), np.concatenate(turn)


#: Odd multipliers of the filter's places, from a fixed seed.
_TURNS = _mixers(4)


def _place(h: np.ndarray, k: int, size: int) -> np.ndarray:
    """Places of hashes in a filter of 2 ** ``size`` bits, in its ``k``-th turn."""
    return (h * _TURNS[k]) >> np.uint64(64 - size)


def leaks_joined(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The same as :func:`leaks` for any number of items: seeds meet in a shuffled join.

    A filter of the items' seeds, of a size that is bounded and grows with their number,
    is held by every task. Documents are read once; those with a seed that passes it are
    written with these seeds, which are joined with the items'. Diagonals on which they
    meet are verified in the words of both texts, which join by number.
    """
    spark = docs.sparkSession
    schema = _schema(docs, items, doc, item)
    it = materialise(items.select(F.monotonically_increasing_id().alias("_item"), F.col(item).alias("_i"), F.col(item_text).alias("_it")))

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p, h = _all_seeds(_hashes(t, known))
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(p), n)), pa.array(p.astype(np.int32))], names=["_h", "_item", "_q"])

    table = materialise(it.select("_item", "_it").mapInArrow(item_seeds, "_h bigint, _item bigint, _q int"))
    size = min(MOST_BITS, max(16, int(table.count() * SEED_BITS).bit_length()))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate([_place(b.column(0).to_numpy().view(np.uint64), k, size) for k in range(len(_TURNS))])
            cells, back = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(cells), np.uint64)
            np.bitwise_or.at(bits, back, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(bits.view(np.int64))], names=["c", "b"])

    cells = table.select("_h").mapInArrow(marks, "c bigint, b bigint").groupBy("c").agg(F.bit_or("b").alias("b")).toPandas()  # at most 2 ** (MOST_BITS - 6)
    mask = np.zeros(1 << size - 6, np.int64)
    mask[cells["c"].to_numpy(np.int64)] = cells["b"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(mask.view(np.uint64))

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        bits = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                b = batch.slice(low, 1000)
                # All texts in one array, so that masks are laid over all at once.
                parts = [_hashes(t, known) for t in b.column(2).to_pylist()]
                start = np.cumsum([0, *[len(x) + SPAN for x in parts[:-1]]])
                pad = np.zeros(SPAN, np.uint64)
                p, h = _all_seeds(np.concatenate([y for x in parts for y in (x, pad)]))
                hit = np.arange(len(h))
                for k in range(len(_TURNS)):
                    at = _place(h[hit], k, size)
                    hit = hit[bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1]
                if not len(hit):
                    continue
                owner = np.searchsorted(start, p[hit], "right") - 1
                order = np.argsort(owner, kind="stable")
                hit, owner = hit[order], owner[order]
                rows, at = np.unique(owner, return_index=True)
                ends = pa.array(np.append(at, len(hit)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (h[hit].view(np.int64), (p[hit] - start[owner]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(rows)).columns, *lists], names=["_doc", "_d", "_dt", "_hs", "_ps"])

    first = docs.select(F.monotonically_increasing_id().alias("_doc"), F.col(doc).alias("_d"), F.col(text).alias("_dt"))
    near = materialise(first.mapInArrow(doc_seeds, f"_doc bigint, _d {docs.schema[doc].dataType.simpleString()}, _dt string, _hs array<bigint>, _ps array<int>"))
    hits = near.select("_doc", F.explode(F.arrays_zip("_hs", "_ps")).alias("x")).select("_doc", F.col("x._hs").alias("_h"), F.col("x._ps").alias("_p"))
    pairs = hits.join(table, "_h").select("_doc", "_item", (F.col("_p") - F.col("_q")).alias("_off")).distinct()
    pairs = pairs.groupBy("_doc", "_item").agg(F.collect_list("_off").alias("_offs"))
    both = pairs.join(near.select("_doc", "_d", "_dt"), "_doc").join(it, "_item").select("_i", "_d", "_it", "_dt", "_offs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            rows = []
            for i, d, it_, dt, offs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                best = _best(_hashes(dt, known), _hashes(it_, known), offs)
                if best:
                    rows.append((i, d, *best))
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [b.schema.field(0).type, b.schema.field(1).type, *[pa.int32()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return both.mapInArrow(verify, schema)


def _best(d: np.ndarray, i: np.ndarray, offs: list[int]) -> tuple[int, int, int, int, int] | None:
    """(text word, item word, words, substitutions, longest exact run): the best overlap of a pair on these diagonals."""
    best = None
    for off in offs:
        a, b = max(0, -off), min(len(i), len(d) - off)
        found = overlap(d[a + off : b + off] == i[a:b])
        if found:
            at, size, wrong, run = found
            row = (a + off + at, a + at, size, wrong, run)
            if best is None or (row[4], row[2], -row[0], -row[1]) > (best[4], best[2], -best[0], -best[1]):
                best = row
    return best


def _search(shared, schema: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                rows = list(index.search(part.column(1).to_pylist()))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([index.keys[i] for i in cols[1]]), part.column(0).take(pa.array(cols[0])), *[pa.array(c, pa.int32()) for c in cols[2:]]],
                        names=[x.split()[0] for x in schema.split(", ")],
                    )

    return run
