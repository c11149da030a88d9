import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallywise.operators import costdiff as C
from tallywise.operators import grouping as G
from tallywise.operators import pricing as P
from tallywise.operators import records as R

PRICE = "model string, input_cost_per_token double, output_cost_per_token double, cache_creation_cost_per_token double, cache_read_cost_per_token double"


def test_keep_max(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice(["x", "y", None]), rnd.choice([None, 0, 1, 2]), "k") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, m string, r string, v long, _k0 string")
    best = {}
    for i, m, r, v, _ in rows:
        key = (m, r) if m and r else (i,)
        best[key] = max(best.get(key, (-1, -1)), (v or 0, i))
    assert sorted(r["id"] for r in R.keep_max(df, ["m", "r"], "v", ["id"]).collect()) == sorted(i for _, i in best.values())
    assert tuple(R.dedup_counts(df, ["m", "r"], "v", ["id"]).first()) == (200, len(best))


def test_times(spark):
    cases = {
        "2025-01-15T10:30:00Z": "2025-01-15 10:30:00", "2025-01-15t10:30:00.5z": "2025-01-15 10:30:00.5", "2025-01-15 10:30:00": "2025-01-15 10:30:00",
        "2025-01-15T10:30:00+02:00": "2025-01-15 08:30:00", "1736937000": "2025-01-15 10:30:00", "1736937000500": "2025-01-15 10:30:00.5", "2025-01-15": None, "10:30": None,
        "": None, "9" * 18: None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "x string").select("x", R.parse_time(F.col("x")).cast("string").alias("t")).collect()
    assert {r["x"]: r["t"] for r in got} == cases


def test_repair(spark):
    t = datetime(2025, 1, 1)
    rnd = random.Random(3)
    rows = [(f"f{i % 7}" if i % 3 else "hot", i, t + timedelta(hours=i) if rnd.random() < 0.3 else None, t) for i in range(300)]
    want, seen = {}, set()
    for f, i, ts, fall in rows:
        if ts:
            seen.add(f)
        if ts or f not in seen:
            want[i] = ts or fall
    got = R.repair_times(spark.createDataFrame(rows, "f string, n long, ts timestamp, m timestamp"), "f", ["n"], "ts", "m")
    assert {r["n"]: r["ts"] for r in got.collect()} == want


def test_filters_and_paths(spark):
    d = spark.createDataFrame([("2025-01-01 23:30:00", "Proj_A%"), ("2025-01-02 00:30:00", None)], "t string, p string").withColumn("t", F.col("t").cast("timestamp"))
    assert [d.where(R.in_range(F.col("t"), *b)).count() for b in (("2025-01-02",), (None, "2025-01-01"), ("2025-01-01 23:30", "2025-01-02"), (None, None, "UTC"))] == [1, 1, 2, 2]
    assert d.where(R.in_range(F.col("t"), "2025-01-02", None, "+05:30")).count() == 2
    assert d.where(R.holds(F.col("p"), "j_a%")).count() == 1 and d.where(R.holds(F.col("p"), None)).count() == 2
    u = "0" * 8 + "-" + "1" * 4 + "-" + "2" * 4 + "-" + "3" * 4 + "-" + "4" * 12
    paths = {
        "/x/projects/-home-me/s.jsonl": ("/home/me", "s", ""), f"/x/projects/p/{u}/subagents/a.jsonl": ("p", u, "a"), "/projects/p/subagents/s_a.jsonl": ("p", "s_a", "s_a"),
        "C:\\projects\\q\\s.jsonl": ("q", "s", ""), "/other/s.jsonl": ("unknown", "s", ""),
    }
    p = F.col("p")
    got = spark.createDataFrame([(k,) for k in paths], "p string").select("p", R.project_of(p).alias("a"), R.session_agent_of(p).alias("s")).collect()
    assert {r["p"]: (r["a"], r["s"]["session_id"], r["s"]["agent_id"]) for r in got} == paths


def test_price_tiers(spark):
    cat = spark.createDataFrame([(k, 1.0, 2.0, 3.0, 4.0) for k in ("alpha-2", "Beta", "alpha", "gamma-9-pro", "")], PRICE)
    names = ["alpha-2", "alpha-2-20250101", "BETA@20250101", "vendor/alpha-2-x", "gamma-9", "zeta", "", None]
    df = spark.createDataFrame([(n, 1, 1, None, 1, 9.0) for n in names], "model string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, _prices double")
    got = {r["model"]: (r["tier"], r["matched"]) for r in P.match_models(df, cat).collect()}
    assert got == {"alpha-2": (1, "alpha-2"), "alpha-2-20250101": (2, "alpha-2"), "BETA@20250101": (3, "Beta"), "vendor/alpha-2-x": (4, "alpha-2"), "gamma-9": (4, "gamma-9-pro")}
    cost = {r["model"]: r["total_cost"] for r in P.price(df, cat).collect()}
    assert cost["alpha-2"] == 7.0 and cost["zeta"] == cost[""] == cost[None] == 0.0
    assert {r[0] for r in P.unpriced(df, cat).collect()} == {"zeta", ""}
    both = P.overlay(cat, spark.createDataFrame([("Beta", 9.0, 9.0, 9.0, 9.0)], PRICE))
    assert both.count() == 5 and both.where("model = 'Beta'").first()[1] == 9.0


def records(spark, rows):
    s = "record_timestamp timestamp, model string, session_id string, project string, agent_id string, tool_names string, line_no int, input_tokens long, output_tokens long"
    return spark.createDataFrame(rows, s)


def test_breakdown(spark):
    t = datetime(2025, 1, 1, 23)
    d = records(spark, [(t + timedelta(hours=i), f"claude-x-2025010{i}", "s", "p" if i else None, "", "", i * 5, 1, 10 + i) for i in range(4)])
    got = {(r["level"], r["parent"], r["child"]): r["output_tokens"] for r in G.breakdown(d, ("day", "model")).collect()}
    assert got[G.TOTAL, None, None] == 46 and got[G.PARENT, "2025-01-02", None] == 36 and got[G.CHILD, "2025-01-01", "x"] == 10 and got[G.TOTAL_CHILD, None, "x"] == 46
    assert [r["parent"] for r in G.in_order(G.breakdown(d, ("line",))).collect()] == ["#0", "#5", "#10", "#15", None]
    assert [r["parent"] for r in G.in_order(G.breakdown(d, ("line",)), True).collect()][:2] == ["#15", "#10"]
    assert G.breakdown(d, ("model", "model")).count() == 4 and G.breakdown(d, ("project",)).where("level = 1").count() == 2
    for dims in ((), ("day",), ("day", "model")):
        assert [tuple(r) for r in G.breakdown(d.where("false"), dims).collect()] == [(G.TOTAL, None, None, 0, 0)]
    with pytest.raises(ValueError):
        G.breakdown(d, ("day", "day", "day"))
    assert G.breakdown(d, ("subagent", "tool")).where("parent = '(main)' and child = '(text)'").count() == 1


def test_series_grain(spark):
    t = datetime(2025, 1, 1)
    for step, n in ((timedelta(hours=1), 5), (timedelta(days=1), 5), (timedelta(days=60), 5)):
        d = records(spark, [(t + step * i, "m", "s", "p", "", "", 1, 1, 2) for i in range(5)])
        assert G.series(d, F.col("output_tokens")).count() == n
    assert G.series(d.where("false"), F.col("output_tokens")).count() == 0


def test_cost_diff(spark):
    a = spark.createDataFrame([(k, 2.0) for k in ("abcdef", "abcd", "xy", "none", "zz", None)], "session_id string, total_cost_usd double")
    b = spark.createDataFrame([("abcd", 1.0), ("abc", 5.0), ("xyz1", 4.0), ("xyz2", 8.0), ("zz", 0.0), (None, 1.0), ("", 3.0)], "session_id string, total_cost double")
    d = C.cost_diff(a, b)
    got = {r["session_id"]: (r["matched_id"], r["diff"], r["diff_pct"]) for r in d.collect()}
    assert got == {"abcdef": ("abcd", 1.0, 100.0), "abcd": ("abcd", 1.0, 100.0), "xy": ("xyz2", -6.0, -75.0), "none": (None, None, None), "zz": ("zz", 2.0, None), None: (None, None, None)}
    t = C.diff_totals(d).first()
    assert (t["reported"], t["computed"], t["matched"], t["unmatched"]) == (8.0, 10.0, 4, 2) and C.diff_totals(d.where("false")).first()["matched"] == 0
