import random

import numpy as np
import pytest

from tallywise.llm import quality as Q
from tallywise.llm.prose import FIGURES, STATS, Lexicon, figures, own_text, passages

WORDS = {
    "en": "a about after an and because been before could do for from had has have i if in is it my not of on so than that the this to was we which who will with would you your",
    "de": "aber dass dem der die ich immer ist mit nicht nie noch und vielleicht war weil wenn wird wurde zu",
}
LEX = Lexicon((k, w) for k, v in WORDS.items() for w in v.split())
PROSE = "We bought the kettle last week and it has not leaked since. If you would like to know more about it, you could ask the people who made that thing."
LIST = "\n".join(f"- {i} mm brass valve (Drumfel)" for i in range(20))
CASES = [
    (PROSE, True), (PROSE.lower().replace(".", "").replace(",", ""), True), (PROSE.replace(" ", "\n", 5), True), (PROSE.replace(" ", "&nbsp;"), True), (LIST, False),
    ("| a | b |\n|---|---|\n" + "\n".join(f"| {i} | ok |" for i in range(9)), False), ("x,y,z\n" + "\n".join(f"{i},no,yes" for i in range(30)), False),
    ("kettle: no\nvalve: 12\n\n" * 12, False), ("🔥🙏 👍 🔥🔥 🙏" * 9, False), ("Zorp " * 90, False), ("q8Zx+/" * 60, False),
    (f"[quote=a]{LIST}[/quote]\n{PROSE}", True), (f"[quote][quote]{PROSE}[/quote]{PROSE}[/quote]\n{LIST}", False), ("> " + PROSE.replace(". ", ".\n> ") + "\n\n" + LIST, False),
    (LIST + "\n\n-- \nme\n" + PROSE, False), (PROSE + "\n--\n" + "me", True), ("Vielleicht ist die Pumpe zu alt, weil der Kessel nicht geprüft wurde.", True),
]


DOCS = "doc_id long, text string, lang string, language string, passages string"


def lexicon_frame(spark):
    return spark.createDataFrame([(k, w) for k, v in WORDS.items() for w in v.split()] + [(None, "x"), ("en", None)], "lang string, word string")


def corpus(n=240, seed=3):
    """(text, prose) documents of many shapes."""
    rnd = random.Random(seed)
    things = "kettle valve pump hose rotor plank gasket lamp spool hinge".split()
    pick = lambda: rnd.choice(things)
    clause = lambda: rnd.choice(
        [f"we have had the {pick()} for a week and it has not leaked since.", f"if the {pick()} is old then that {pick()} will be next,", f"who would do it with my {pick()} before the {pick()} could be had?",
         f"because i was in the way of your {pick()} you have to wait.", f"so this {pick()} is not for us about which we could do that."]
    )
    prose = lambda: " ".join(clause() for _ in range(rnd.randint(3, 9)))
    junk = [
        lambda: "\n".join(f"- {rnd.randint(1, 99)} mm {pick()} for my {pick()}" for _ in range(rnd.randint(9, 30))),
        lambda: "\n".join(f"{pick()},{rnd.randint(1, 999)},yes,{pick()}" for _ in range(rnd.randint(9, 30))),
        lambda: "".join(rnd.choice("🔥🙏👍 ") for _ in range(200)),
        lambda: " ".join("".join(rnd.choice("qxzwkv8/+") for _ in range(rnd.randint(5, 22))) for _ in range(40)),
    ]
    return [((rnd.choice(junk)(), False) if i % 6 == 0 else (prose(), True)) for i in range(n)]


def test_figures_by_hand():
    assert own_text("a wrote:\n> b\nc\n[quote]d[/quote]\n-- \ne") == "c"
    assert figures("It was ok.\nthe end", LEX) == pytest.approx((5, 13 / 5, 1 / 14, 1 / 2, 3 / 5))
    assert figures("> It was ok.\n> yes", LEX) == pytest.approx((4, 10 / 4, 3 / 13, 1 / 2, 2 / 4))
    assert figures("[quote=a]Who is it?[/quote]\nIt was\n\n-- \nme", LEX) == pytest.approx((6, 14 / 6, 9 / 34, 0, 5 / 6))
    assert figures(None, LEX) == figures("", LEX) == figures(" \n", LEX) == (0, 0.0, 0.0, 0.0, 0.0)


def test_passages_by_hand():
    lang, size, flat, bags = passages("It was 12 ok.\nthe end\n\n- brass A", LEX)
    assert (lang, size, len(flat)) == ("en", 23, 2 * (1 + len(STATS))) and bags[1] == {"brass": 1, "a": 1}
    assert flat[:11] == pytest.approx([16, 3 / 6, 3 / 6, 13 / 6, 1 / 16, 1 / 2, 1 / 6, 3, 13 / 16, 1 / 6, 1])
    assert passages("12", LEX, "DE-at")[0] == "de" and passages("12", LEX)[0] is None
    assert passages(None, LEX)[:3] == passages("> only\n> quoted", LEX)[:3] == (None, 0, [])


def test_tails_match_brute_force(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), float(rnd.choice([1, 1, 1, 2, 3, rnd.randint(4, 90)])), 1) for _ in range(900)]
    df = spark.createDataFrame(rows + [(None, 1.0, 1), ("a", None, 1)], "g string, v double, n int")
    got = {(r["g"], r["v"]): tuple(r)[2:] for r in Q.tails(df, ["g"], "v").collect()}
    for (g, v), found in got.items():
        mine = [x for k, x, _ in rows if k == g]
        assert found == (mine.count(v), sum(x <= v for x in mine), sum(x >= v for x in mine), len(mine))
    assert len(got) == len(set(rows)) and Q.tails(df.where("false"), ["g"], "v").count() == 0


def test_half_of_the_characters_decides():
    score = Q.Scorer(None, None).documents(3, np.array([0, 0, 0, 2, 2]), np.array([2.0, 5, 4, 3, 3]), np.array([1.0, -1, 2, 5, -5]))
    assert score[0] == 1.0 and np.isnan(score[1]) and score[2] == -5.0


def test_weights_are_not_negative():
    rnd = np.random.default_rng(1)
    x = rnd.exponential(1, (400, 2 * len(STATS)))
    y = (x[:, 0] + x[:, 7] > 3).astype(float)
    b = Q.fit(x, y, np.ones(400))
    assert (b[:-1] >= 0).all() and ((x @ b[:-1] + b[-1] > 0) == y).mean() > 0.95 and b[[0, 7]].min() > np.delete(b[:-1], [0, 7]).max()


def test_score_decides(spark):
    data = corpus()
    docs = spark.createDataFrame([(i, t, "en", "x", "y") for i, (t, _) in enumerate(data)], DOCS)
    labels = spark.createDataFrame([(i, "r", "prose" if p else "not prose") for i, (_, p) in enumerate(data[:150])] + [(151, "r", "unsure"), (None, "r", "prose"), (0, "q", None)], "doc_id long, rater string, label string")
    scored = Q.outlier_scores(docs, lexicon_frame(spark), labels)
    got, want = {r["doc_id"] for r in Q.not_prose(scored).collect()}, {i for i, (_, p) in enumerate(data) if not p}
    assert len(got & want) >= 0.95 * max(len(got), len(want))
    for r in scored.collect():
        assert (r["outlier_score"] > 0) == (r["outlier_share"] > 0.5)


def test_edge_cases(spark):
    rows = [(i, t, "en", "odd", "odd") for i, (t, _) in enumerate(CASES)] + [(90, None, None, "", ""), (91, "", "de", "", ""), (92, "> q", "x", "", ""), (None, LIST, None, "", ""), (4, LIST, "en", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    out = Q.outlier_scores(docs, lexicon_frame(spark), keep=["lang"])
    assert out.count() == len(rows) and out.where("own_chars = 0 and outlier_score is null and outlier_share = 0").count() == 3
    assert out.columns == ["doc_id", "lang", *FIGURES, "language", "own_chars", "outlier_share", "outlier_score"]
    assert "words" not in Q.outlier_scores(docs, lexicon_frame(spark), with_figures=False).columns
    assert Q.outlier_scores(docs.where("false"), lexicon_frame(spark).where("false"), lang=None).count() == 0
