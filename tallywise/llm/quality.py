"""Text quality: passages, exact ranks per language, and outlier scores from their tails.

1. The own text of a document is cut into passages, each with its statistics.
2. Every statistic is ranked exactly within its language: different values are
   counted, range-partitioned and sorted; ranks are running counts inside a
   partition plus the counts of the partitions before it.
3. A passage's score is the weighted sum of the negative logarithms of its lower
   and upper tail probabilities. Weights aren't negative; they and the bar (a
   score of 0) are fitted to a bounded sample of labelled documents.
4. Outliers are left out of the reference and 2 and 3 done again, so that junk,
   where there is much of it, doesn't make itself common.
5. A document's score is that of its passages at half of its characters: it is
   above the bar exactly if more than half of them are in outlying passages.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywise.llm.prose import FIGURES, NEUTRAL, STATS, Lexicon, figures, passages
from tallywise.plans.scale import dense_partitions, join_checked, materialise

#: Language of a text that has no common word of any; its values are ranked among those of all languages.
NO_LANGUAGE = "und"
#: Most labelled documents that the weights are fitted to; taken in order of a hash of the key.
LABELLED = 5_000
#: Most common words, which every task holds; a longer table is refused, not cut.
LEXICON_ROWS = 1_000_000
#: Least and most evidence of a word, and what its counts are smoothed by.
WORD_LOW, WORD_HIGH, SMOOTH = -1.0, 2.5, 0.5
#: Strength of the pull to PRIOR; rounds of ranking.
RIDGE, ROUNDS = 1.0, 2
#: Weights (lower, upper tail) without labels, and the bar: little evidence, many symbols, long words, many digits.
PRIOR = {"evidence": (0.6, 0.3), "common_share": (0.2, 0.0), "mean_word": (0.2, 0.1), "symbol_share": (0.0, 0.4), "digit_share": (0.0, 0.3), "distinct_share": (0.3, 0.0)}
PRIOR_BAR = -7.0
_WIDTH = 1 + len(STATS)


def _rounded(x: np.ndarray) -> np.ndarray:
    """Statistics as they are ranked: to three decimals, from 1 on to three digits; so a statistic has at most some thousand different values."""
    big = np.abs(x) >= 10
    unit = np.power(10.0, np.floor(np.log10(np.where(big, np.abs(x), 10.0))) - 2)
    return np.where(big, np.round(x / unit) * unit, np.round(x, 3)).round(3)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each passage, its characters, its statistics) of a batch."""
    lists = batch.column(batch.schema.get_field_index("passages"))
    flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, _WIDTH)
    sizes = np.diff(lists.offsets.to_numpy()) // _WIDTH
    return np.repeat(np.arange(batch.num_rows), sizes), flat[:, 0], flat[:, 1:]


def parsed(docs: DataFrame, lex: Lexicon, key: str, text: str, lang: str | None, keep: Sequence[str], with_figures: bool) -> DataFrame:
    """(key, keep..., [FIGURES], language, own_chars, passages): one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    extra = list(FIGURES) if with_figures else []
    first = docs.select(F.col(key).alias("_key"), *keep, (F.col(lang) if lang else F.lit(None).cast("string")).alias("_lang"), F.col(text).alias("_text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first.schema.fields[:-2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for b in batches:
            hints, texts = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            rows = [passages(t, lexicon, h) for t, h in zip(texts, hints, strict=True)]
            cols = [pa.array([r[0] or NO_LANGUAGE for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([_flat(r[2]) for r in rows], pa.list_(pa.float64()))]
            if extra:
                figs = list(zip(*(figures(t, lexicon) for t in texts), strict=True)) or [()] * len(extra)
                cols = [pa.array(c, pa.int64() if i == 0 else pa.float64()) for i, c in enumerate(figs)] + cols
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *cols], names=[*b.schema.names[:-2], *extra, "language", "own_chars", "passages"])

    kinds = "".join(f", {c} {'bigint' if i == 0 else 'double'}" for i, c in enumerate(extra))
    return first.mapInArrow(run, f"{head}{kinds}, language string, own_chars bigint, passages array<double>").withColumnRenamed("_key", key)


def _flat(values: list[float]) -> np.ndarray:
    x = np.array(values, float).reshape(-1, _WIDTH)
    return np.concatenate([x[:, :1], _rounded(x[:, 1:])], axis=1).ravel()


def counted(p: DataFrame, inside: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(language, stat, value, n): passages by value; equal ones are counted in each batch before the shuffle.

    ``inside`` (languages, statistics) says which passages count. NO_LANGUAGE has the
    passages of all languages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, _, x = _columns(b)
            lang = np.array(b.column("language").to_pylist(), object)[row]
            if inside is not None and len(row):
                sure = inside(lang, x)
                lang, x = lang[sure], x[sure]
            out: list[tuple] = []
            for k in set(lang):
                for j, s in enumerate(STATS):
                    v, n = np.unique(x[lang == k, j], return_counts=True)
                    out += zip([k] * len(v), [s] * len(v), v.tolist(), n.tolist(), strict=True)
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64(), pa.int64()), strict=True)], names=["language", "stat", "value", "n"])

    each = p.select("language", "passages").mapInArrow(run, "language string, stat string, value double, n bigint")
    each = each.groupBy("language", "stat", "value").agg(F.sum("n").alias("n"))
    every = each.groupBy("stat", "value").agg(F.sum("n").alias("n")).select(F.lit(NO_LANGUAGE).alias("language"), "stat", "value", "n")
    return each.where(F.col("language") != NO_LANGUAGE).unionByName(every)


def tails(counts: DataFrame, by: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """(by..., value, n, at_most, at_least, total): exact ranks of each value within its group, from rows that count values.

    Counts with a null in ``by`` or ``value`` are left out. A value or group of any
    number of rows is one row in the sort.
    """
    sure: Column = F.col(value).isNotNull()
    for c in by:
        sure = sure & F.col(c).isNotNull()
    d = counts.where(sure).groupBy(*by, value).agg(F.sum(n).alias("n"))
    d = dense_partitions(d, by, [F.col(value)])
    part = d.groupBy("__pid", *by).agg(F.sum("n").alias("_m"))
    up = Window.partitionBy(*by).orderBy("__pid")
    before = F.coalesce(F.sum("_m").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.select("__pid", *by, before.alias("_before"), F.sum("_m").over(Window.partitionBy(*by)).alias("total"))
    d = d.withColumn("_run", F.sum("n").over(Window.partitionBy("__pid", *by).orderBy(value)))
    d = join_checked(d, part, ["__pid", *by])
    le = F.col("_before") + F.col("_run")
    return d.select(*by, value, "n", le.alias("at_most"), (F.col("total") - le + F.col("n")).alias("at_least"), "total")


class Ranks:
    """Exact ranks by language and statistic; bounded, since statistics are rounded."""

    def __init__(self, rows: Sequence[tuple]):
        groups: dict[tuple[str, str], list] = {}
        for lang, stat, value, at_most in rows:
            groups.setdefault((lang, stat), []).append((value, at_most))
        self.table = {k: tuple(np.array(sorted(v), float).T) for k, v in groups.items()}

    def logs(self, lang: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Negative logarithms of the lower and upper tail of each statistic, two columns each; a value counts itself once more."""
        out = np.zeros((len(x), 2 * len(STATS)))
        for k in set(lang):
            at = np.flatnonzero(lang == k)
            for j, s in enumerate(STATS):
                v, cum = self.table.get((k, s)) or self.table.get((NO_LANGUAGE, s), (np.zeros(0), np.zeros(0)))
                cum = np.concatenate([[0.0], cum])
                y = x[at, j]
                out[at, 2 * j] = -np.log((cum[np.searchsorted(v, y, "right")] + 1) / (cum[-1] + 1))
                out[at, 2 * j + 1] = -np.log((cum[-1] - cum[np.searchsorted(v, y, "left")] + 1) / (cum[-1] + 1))
        return np.maximum(out, 0.0)


def word_weights(rows: Sequence[tuple[str | None, list[Counter], bool]], lex: Lexicon) -> dict[tuple[str, str], float]:
    """(language, word) -> evidence: logarithm of how much more frequent a common word is in prose than in other labelled texts."""
    seen = {False: {}, True: {}}
    for lang, bags, prose in rows:
        for bag in bags:
            c = seen[prose].setdefault(lang, Counter())
            c[None] += sum(bag.values())
            for w, n in bag.items():
                if w in lex.marks:
                    c[w] += n
    out = {}
    for w, marks in lex.marks.items():
        for i, _ in marks:
            lang = lex.langs[i]
            good, bad = seen[True].get(lang, Counter()), seen[False].get(lang, Counter())
            if good[w] + bad[w]:
                ratio = (good[None] + 20) / (bad[None] + 20)
                x = np.log((good[w] + SMOOTH * min(1.0, ratio)) / (bad[w] + SMOOTH / max(1.0, ratio))) - np.log(ratio)
                out[lang, w] = float(min(WORD_HIGH, max(WORD_LOW, x)))
            else:
                out[lang, w] = NEUTRAL
    return out


def fit(logs: np.ndarray, outlying: np.ndarray, weight: np.ndarray, steps: int = 3_000) -> np.ndarray:
    """Weights, none negative, and the bar of a logistic regression drawn to PRIOR; projected accelerated gradient descent."""
    prior = np.array([w for s in STATS for w in PRIOR.get(s, (0.0, 0.0))] + [PRIOR_BAR])
    if not len(logs):
        return prior
    a = np.c_[logs, np.ones(len(logs))]
    pull = np.r_[np.full(len(prior) - 1, RIDGE), RIDGE / 50]
    rate = 1 / (0.25 * np.linalg.eigvalsh((a * weight[:, None]).T @ a)[-1] + RIDGE)
    b, z, t = prior.copy(), prior.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -40, 40)))
        new = z - rate * (a.T @ (weight * (p - outlying)) + pull * (z - prior))
        new[:-1] = np.maximum(new[:-1], 0)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, b, t = new + (t - 1) / u * (new - b), new, u
    return b


@dataclass
class Scorer:
    """Ranks and weights: scores of passages and documents; outliers are above 0."""

    ranks: Ranks
    weights: np.ndarray

    def passages(self, lang: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.ranks.logs(lang, x) @ self.weights[:-1] + self.weights[-1]

    def documents(self, rows: int, row: np.ndarray, size: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The least score such that at least half of a document's characters are in passages of at most it; nan without characters."""
        out = np.full(rows, np.nan)
        order = np.lexsort([score, row])
        row, size, score = row[order], size[order], score[order]
        total = np.bincount(row, weights=size, minlength=rows)
        upto = np.cumsum(size)
        before = np.concatenate([[0.0], np.cumsum(total)])
        half = np.flatnonzero((2 * (upto - before[row]) >= total[row]) & (total[row] > 0))[::-1]
        out[row[half]] = score[half]
        return out


def _labelled(docs: DataFrame, labels: DataFrame | None, key: str, text: str, lang: str | None) -> list[tuple]:
    """(language hint, text, prose) of at most LABELLED documents on which most raters agree."""
    if labels is None:
        return []
    vote = F.sum(F.when(F.col("label") == "prose", 1).when(F.col("label") == "not prose", -1).otherwise(0)).alias("_vote")
    votes = labels.where(F.col(key).isNotNull()).groupBy(key).agg(vote).where("_vote <> 0").orderBy(F.xxhash64(key), key).limit(LABELLED)
    hint = F.col(lang) if lang else F.lit(None).cast("string")
    return [tuple(r) for r in docs.join(F.broadcast(votes), key).select(hint, text, F.col("_vote") > 0).collect()]


def outlier_scores(
    docs: DataFrame, common_words: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", lang: str | None = "lang", keep: Sequence[str] = (),
    with_figures: bool = True,
) -> DataFrame:
    """(key, keep..., [FIGURES], language, own_chars, outlier_share, outlier_score), one row per row of ``docs``.

    FIGURES are those of the whole text; the rest is of the own text: its language,
    characters, their share in outlying passages, and the score, above 0 if that share
    is more than half. Null and empty texts have zeros, NO_LANGUAGE and a null score.
    ``lang`` only decides between languages with equally many common words. ``labels``
    has ``key`` and ``label`` (prose, not prose; others don't count); without usable
    labels PRIOR holds. Rows may repeat; each is scored by itself.

    Texts are parsed once; passages are written, then read once a round. Rank tables
    are at most some thousand values per statistic and language.
    """
    rows = [tuple(r) for r in common_words.select("lang", "word").where("lang is not null and word is not null").distinct().limit(LEXICON_ROWS + 1).collect()]
    if len(rows) > LEXICON_ROWS:
        raise ValueError(f"more than {LEXICON_ROWS} common words: that isn't a list of frequent words")
    lex = Lexicon(sorted(rows))
    sample = _labelled(docs, labels, key, text, lang)
    first = [(*passages(t, lex, h), prose) for h, t, prose in sample]
    lex = Lexicon(sorted(rows), word_weights([(k, bags, prose) for k, _, _, bags, prose in first], lex))
    names, values, weight, bad = [], [], [], []
    for k, size, flat, bags, prose in first:
        # Only the evidence rests on the weights.
        for i, bag in enumerate(bags):
            flat[_WIDTH * i + 1] = max(lex.count(bag)[1], default=0.0) / (sum(bag.values()) or 1)
        x = _flat(flat).reshape(-1, _WIDTH)
        names += [k or NO_LANGUAGE] * len(x)
        values.append(x[:, 1:])
        weight.append(x[:, 0] / max(1, size))
        bad += [not prose] * len(x)
    known, outlying = np.array(names, object), np.array(bad, float)
    table = np.concatenate(values) if values else np.zeros((0, len(STATS)))
    share = np.concatenate(weight) if weight else np.zeros(0)
    if share @ outlying > 0:
        share = np.where(outlying > 0, share * (share @ (1 - outlying)) / (share @ outlying), share)
    else:
        known, outlying, table, share = known[:0], outlying[:0], table[:0], share[:0]
    sc = docs.sparkSession.sparkContext
    p = materialise(parsed(docs, lex, key, text, lang, keep, with_figures))
    inside, scorer = None, None
    for _ in range(ROUNDS):
        ranks = Ranks([tuple(r) for r in tails(counted(p, inside), ["language", "stat"], "value").select("language", "stat", "value", "at_most").collect()])
        scorer = sc.broadcast(Scorer(ranks, fit(ranks.logs(known, table), outlying, share)))
        inside = lambda k, x, s=scorer: s.value.passages(k, x) <= 0
    return _scored(p, scorer)


def _scored(p: DataFrame, scorer) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer.value
        for b in batches:
            row, size, x = _columns(b)
            score = s.passages(np.array(b.column("language").to_pylist(), object)[row], x)
            total = np.bincount(row, weights=size, minlength=b.num_rows)
            share = np.bincount(row, weights=size * (score > 0), minlength=b.num_rows) / np.maximum(total, 1)
            doc = s.documents(b.num_rows, row, size, score)
            cols = [pa.array(share), pa.array(doc, mask=np.isnan(doc))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*b.schema.names[:-1], "outlier_share", "outlier_score"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema.fields[:-1])
    return p.mapInArrow(run, f"{head}, outlier_share double, outlier_score double")


def not_prose(scored: DataFrame) -> DataFrame:
    """Rows whose score is above the bar: more than half of the own characters are in outlying passages. Texts without own characters are none."""
    return scored.where(F.col("outlier_score") > 0)
