import random

import numpy as np

from tallywise.llm import leakage as L
from tallywise.llm.markup import words

VOCAB = [f"w{i}" for i in range(60)]


def longest(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                new[j] = row[j - 1] + 1
                best = max(best, new[j])
        row = new
    return best


def test_words():
    t = "[quote=Bob]The <b>old</b> “Kiln”, don't\n> stop&nbsp;now​!<br>[img]a.jpg[/img] ZÄHLER[/quote]"
    assert words(t) == ["the", "old", "kiln", "don", "t", "stop", "now", "zähler"] and words(None) == words("") == []


def test_exact_runs_match_brute_force(spark):
    rnd = random.Random(4)
    items = [(i, " ".join(rnd.choices(VOCAB, k=rnd.choice([5, 12, 13, 40])))) for i in range(30)] + [(30, None), (31, ""), (2, "w1 w2 " * 10)]
    docs = []
    for d in range(300):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            src = (rnd.choice(items[:30])[1]).split()
            a, n = rnd.randrange(len(src)), rnd.randint(8, 20)
            parts += rnd.choices(VOCAB, k=rnd.randint(0, 15)) + src[a : a + n]
        docs.append((d, rnd.choice([" ", ", ", "\n> "]).join(parts) or None, 0))
    got = L.leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r["item_id"], r["doc_id"]) for r in got.where(f"exact_run >= {L.SPAN}").collect()}
    want = {(i, d) for i, t in items if t for d, x, _ in docs if x and longest(words(t), words(x)) >= L.SPAN}
    assert found == want and len(want) > 30


def test_substitutions_and_many_items(spark, monkeypatch):
    item = [f"q{i}" for i in range(40)]
    doc = list(item)
    for k in (6, 17, 29):
        doc[k] = "other"
    items = spark.createDataFrame([(i, " ".join(item if i == 3 else [f"z{i}x{k}" for k in range(20)])) for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "intro words " + " ".join(doc)), (2, " ".join(item[:12]))], "doc_id long, text string")
    rows = L.leaks(docs, items).collect()
    monkeypatch.setattr(L, "HELD_CHARS", 200)
    assert L.leaks(docs, items).collect() == rows
    assert [(r["item_id"], r["doc_id"], r["doc_word"], r["item_word"], r["words"], r["substitutions"], r["exact_run"]) for r in rows] == [(3, 1, 2, 0, 40, 3, 11)]


def test_masks_and_empty_tables(spark):
    assert all(len(m) == L.SPAN and m[0] == m[-1] == "1" for m in L.MASKS) and len(L.seeds(np.arange(5, dtype=np.int32), L.MASKS[0])[0]) == 0
    d, i = spark.createDataFrame([(1, "a " * 50)], "doc_id long, text string"), spark.createDataFrame([(1, "a " * 50)], "item_id long, text string")
    assert L.leaks(d, i.where("false")).count() == 0 and L.leaks(d.where("false"), i).count() == 0
    assert L.leaks_joined(d, i.where("false")).count() == 0 and L.leaks_joined(d.where("false"), i).count() == 0
    for r in (L.leaks(d, i).collect(), L.leaks_joined(d, i).collect()):
        assert len(r) == 1 and r[0]["exact_run"] == 50


def test_many_items_with_one_opening(spark):
    """Items that share their opening leak it all, and none is lost; keys may be null or repeat."""
    opening = " ".join(f"o{k}" for k in range(16))
    items = [(i % 50 if i % 7 else None, f"{opening} " + " ".join(f"x{i}y{k}" for k in range(9))) for i in range(120)]
    docs = [(d, f"so {opening} end" if d % 3 else "nothing of it") for d in range(30)] + [(None, opening), (4, None)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    a, b = (sorted(map(str, f(*frames).collect())) for f in (L.leaks, L.leaks_joined))
    assert a == b and len(a) == 120 * 21 and all("exact_run=16" in x for x in a)


def test_seeds_hit_every_accepted_overlap():
    seen = []

    def grow(bits):
        for gap in range(1, L.GAP + 1):
            for run in range(1, L.SPAN):
                new = [*bits, *[0] * gap, *[1] * run]
                if sum(new) >= L.SIMILARITY * len(new):
                    seen.append(new) if len(new) >= L.SPAN else grow(new)

    for first in range(1, L.SPAN):
        grow([1] * first)
    marks = [np.array(list(m), int) for m in (*L.MASKS, L.RUN)]
    assert len(seen) == 2832 and all(L.overlap(np.array(s, bool)) for s in seen)
    for s in seen:
        assert any((np.lib.stride_tricks.sliding_window_view(s, len(m)) >= m).all(1).any() for m in marks if len(m) <= len(s)), s


def test_tolerant_overlaps_match_brute_force(spark):
    rnd = random.Random(7)
    items = [(i, " ".join(rnd.choices(VOCAB, k=rnd.choice([13, 16, 30, 60])))) for i in range(25)]
    docs = []
    for d in range(200):
        parts = []
        for _ in range(rnd.randint(0, 3)):
            src = rnd.choice(items)[1].split()
            a = rnd.randrange(len(src))
            part = src[a : a + rnd.randint(10, 30)]
            for k in rnd.sample(range(len(part)), len(part) * rnd.randint(0, 3) // 12):
                part[k] = rnd.choice(["other", *VOCAB])
            parts += rnd.choices(VOCAB, k=rnd.randint(0, 15)) + part
        docs.append((d, " ".join(parts)))
    want = {}
    for d, x in docs:
        for i, t in items:
            a, b = np.array(x.split()), np.array(t.split())
            for off in range(-len(b) + 1, len(a)):
                lo, hi = max(0, -off), min(len(b), len(a) - off)
                found = L.overlap(a[lo + off : hi + off] == b[lo:hi])
                if found:
                    at, size, wrong, run = found
                    row = (run, size, -(lo + off + at), -(lo + at), wrong)
                    want[i, d] = max(want.get((i, d), row), row)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for got in (L.leaks(*frames).collect(), L.leaks_joined(*frames).collect()):
        assert {(r["item_id"], r["doc_id"]): (r["exact_run"], r["words"], -r["doc_word"], -r["item_word"], r["substitutions"]) for r in got} == want
        assert len(got) == len(want)
    assert sum(w[4] > 1 and w[0] < 9 for w in want.values()) > 20
