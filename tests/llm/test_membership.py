import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from tallywise.llm import membership as M

SCHEMA = "session_id string, day date, project string, n string"
GRAINS = {"day": ("day",), "project": ("project",), "pair": ("day", "project")}


def data(n=1500, seed=1):
    rnd = random.Random(seed)
    days = [date(2025, 1, 1) + timedelta(days=k) for k in range(12)] + [None]
    rows = [(rnd.choice([f"s{rnd.randint(0, 90)}", None]), rnd.choice(days), rnd.choice(["a", "b", "unknown", None]), "x") for _ in range(n)]
    return rows + [("hot", d, f"p{k}", "x") for k in range(60) for d in days[:5]]


def state(df):
    return M.state(df, "session_id", {"day": F.col("day"), "project": F.col("project")})


def brute(rows):
    out = {}
    for s, d, p, _ in rows:
        if s is not None:
            for k in (("day", d, None), ("project", None, p), ("pair", d, p)):
                out.setdefault(k, set()).add(s)
    return {k: len(v) for k, v in out.items()}


def counted(pat):
    return {(r["grain"], r["day"], r["project"]): r["n_ids"] for r in M.counts(pat, GRAINS).collect()}


def test_counts_are_exact_with_wide_identifiers(spark, monkeypatch):
    rows = data()
    rows += [("hot twin", *r[1:]) for r in rows if r[0] == "hot"]
    df = spark.createDataFrame(rows, SCHEMA)
    assert counted(M.patterns(state(df))) == brute(rows)
    monkeypatch.setattr(M, "PART_GROUPS", 20)
    pat = M.patterns(state(df)).cache()
    assert counted(pat) == brute(rows)
    # The twins have one pattern of many bounded parts, counted as 2.
    wide = pat.where("parts > 1").groupBy("pattern_id").agg(F.max("n").alias("n"), F.sum(F.size("groups")).alias("k"), F.max(F.size("groups")).alias("most")).collect()
    assert [(r["n"], r["k"]) for r in wide if r["k"] == 300] == [(2, 300)] and all(r["most"] < 60 for r in wide)
    assert pat.where("n is null").count() == 0
    both = {r[0] for r in rows if r[2] == "p7"} & {r[0] for r in rows if r[2] == "p11"}
    assert M.combination(pat, all_of=[F.col("project") == "p7", F.col("project") == "p11"]).first()["n"] == len(both) == 2


def test_parts_merge_and_combine(spark):
    rows = data(seed=2)
    df = spark.createDataFrame(rows, SCHEMA)
    pat = M.patterns(M.merge(state(df.where("project = 'a' or project is null")), state(df.where("day < '2025-01-09'")), state(df)))
    assert counted(pat) == brute(rows)
    in_a, late = {r[0] for r in rows if r[2] == "a"} - {None}, {r[0] for r in rows if r[1] and r[1].day > 10} - {None}
    ask = lambda **k: M.combination(pat, **k).first()["n"]
    a, b = F.col("project") == "a", F.dayofmonth("day") > 10
    assert ask(all_of=[a, b]) == len(in_a & late) and ask(any_of=a | b) == len(in_a | late) and ask(any_of=F.lit(False)) == 0


def test_empty(spark):
    pat = M.patterns(state(spark.createDataFrame([], SCHEMA)))
    assert M.counts(pat, GRAINS).count() == 0 and M.combination(pat, any_of=F.lit(True)).first()["n"] == 0
