import random

import pytest
from pyspark.sql import functions as F

import model as M
from tallywise.operators import counters as C
from tallywise.operators import status as S
from tallywise.plans.ordered import Ordered


def frame(spark, data):
    names = [c.split()[0] for c in M.SCHEMA.split(", ")]
    return S.valid(spark.createDataFrame([tuple(r[n] for n in names) for r in data], M.SCHEMA))


@pytest.fixture(scope="module")
def data():
    return M.rows(500, 11)


@pytest.fixture(scope="module")
def df(spark, data):
    return frame(spark, data).cache()


def test_sessions(df, data):
    got = {r["session_id"]: tuple(r[c] for c in ("segments", *M.COUNTERS)) for r in S.sessions(df).collect()}
    want = M.sessions(data)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_cumulative(df, data):
    got = {r["snap_id"]: r for r in S.cumulative(df).collect()}
    assert len(got) == len(data)
    for recs in M.by_session(data).values():
        for i, r in enumerate(recs):
            assert [got[r["snap_id"]][f"cum_{c}"] for c in M.COUNTERS] == pytest.approx(M.totals(recs[: i + 1])[1])


@pytest.mark.parametrize("kind", ["1h", "5h", "1w"])
def test_windows(df, data, kind):
    got = {}
    for r in S.windows(df, kind).collect():
        got[r["window_start"], r["window_end"]] = tuple(r[c] for c in ("sessions", "min_five_hour_pct", "max_five_hour_pct", *M.COUNTERS))
    want = M.windows(data, kind)
    if kind == "1h":  # hours of windows that end at different times stay apart
        assert sum(1 for _ in got) == len(want)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_actions(df, data):
    got = sorted((r["snap_id"], r["cost_delta"]) for r in S.actions(df).collect())
    want = M.actions(data)
    assert [a for a, _ in got] == [a for a, _ in want] and [b for _, b in got] == pytest.approx([b for _, b in want])


def test_roll_ups_agree(df, data):
    s = S.sessions(df)
    total = S.totals(s).first()
    for d in (S.by_project(s), S.by_day(s, "Asia/Tokyo")):
        assert d.agg({"total_cost_usd": "sum"}).first()[0] == pytest.approx(total["total_cost_usd"]) and d.agg({"sessions": "sum"}).first()[0] == total["sessions"]
    c = S.cumulative_cost(s).orderBy("session_id").collect()
    assert c[-1]["cumulative"] == pytest.approx(total["total_cost_usd"])


def test_empty_and_invalid(spark, df):
    none = df.where("false")
    for d in (S.sessions(none), S.actions(none), S.windows(none, "5h"), S.cumulative(none), S.by_day(S.sessions(none))):
        assert d.count() == 0
    bad = spark.createDataFrame([(None,), (1,)], "x long").selectExpr("x snap_id", "1L ts", "'s' session_id", "1.0D total_cost_usd", "1L total_duration_ms")
    assert tuple(S.rejected(bad).first()) == (1, 1)


def test_overlap_budget_and_percent(spark):
    d = spark.createDataFrame([(0, 10, 4), (10, 10, 0), (0, 100, 1)], "a long, b long, delta int")
    r = d.select(S.overlap_ratio(F.col("a"), F.col("b"), [(5, 8), (9, 20)]).alias("o"), S.budget(F.lit(2.0), F.col("delta"), F.lit(1.0)).alias("b")).collect()
    assert [x["o"] for x in r] == [0.4, 0.0, 0.14] and [x["b"] for x in r] == [25.0, None, 100.0]
    p = spark.createDataFrame([(x,) for x in (None, 2.5, 2.4, 300.0, -3.0)], "x double").select(S.percent(F.col("x"))).collect()
    assert [x[0] for x in p] == [None, 3, 2, 255, 0]


@pytest.mark.parametrize("rows", ["few", "many"])
def test_ordered_matches_plain_windows(spark, rows):
    from pyspark.sql import Window

    one = {"few": "true", "many": "false"}[rows]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", one)
    try:
        _compare(spark, Window, rows == "few")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")


def _compare(spark, Window, alone):
    d = spark.range(2000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 97 = 0 then null else concat('k', id % 40) end k", "hash(id) % 50 v", "'p' __pid")
    o = Ordered(d, ["k"], ["id"]).lag(["v"]).running(sums={"s": F.col("v")}, maxes={"m": F.when(F.col("v") > 0, F.col("v"))})
    assert o._alone is alone
    w = Window.partitionBy("k").orderBy("id")
    want = d.select("id", F.lag("v").over(w).alias("prev_v"), F.sum("v").over(w).alias("s"), F.max(F.when(F.col("v") > 0, F.col("v"))).over(w).alias("m"))
    got = o.df.select("id", "prev_v", "s", "m")
    assert got.exceptAll(want).count() == 0 and got.count() == 2000


def test_groups_reach_over_several_partitions(spark):
    d = spark.range(3000).selectExpr("id", "case when id % 3 > 0 then 'hot' else 'k' end k")
    o = Ordered(d, ["k"], ["id"])
    assert o._all.select("__pid").distinct().count() > 2 and o._all.where("k = 'hot'").select("__pid").distinct().count() > 1
    s = o.running(sums={"n": F.lit(1)}).df
    assert s.groupBy("k").agg(F.max("n").alias("n"), F.countDistinct("n").alias("d")).where("n <> d").count() == 0


def test_scan_over_many_partitions_and_batches(spark, data):
    """A hot session over many partitions, marks at and between its rows, and batches that end anywhere."""
    rnd = random.Random(5)
    hot = [("hot", t // 2, 1, i, float(rnd.choice([rnd.random() * 9, i % 40, 0.0])), rnd.randint(0, 900), i % 50) for i, t in enumerate(sorted(rnd.randint(0, 3000) for _ in range(700)))]
    rest = [(f"s{i % 9}", i, 1, 10_000 + i, float(i % 7), i * 37 % 1000, i % 5) for i in range(150)]
    marks = [(k, t, 0, None, None, None, None) for k in ("hot", "s1", "s4", "none") for t in range(-1, 1700, 11)]
    df = spark.createDataFrame(hot + rest + marks, "k string, t long, row int, seq long, cost double, ms long, n long")
    for size, parts in (("10000", "4"), ("23", "13"), ("7", "60")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {(r["k"], r["t"], r["row"], r["seq"]): (r["segment"], r["cum_cost"], r["cum_ms"], r["cum_n"]) for r in C.scan(df, "k", ["t", "row", "seq"], ["cost", "ms", "n"], "row").collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert len(got) == len(hot + rest + marks)
        for k in {r[0] for r in marks} | {r[0] for r in rest}:
            seg, top, closed, last = 1, None, [0.0] * 3, None
            for r in sorted((r for r in hot + rest + marks if r[0] == k), key=lambda r: (r[1], r[2], r[3] or 0)):
                if r[2]:
                    now = r[4:7]
                    if last and (last[0] > 1e-4 or last[1] > 100) and (now[0] < last[0] - 1e-4 or now[1] + 100 < last[1]):
                        seg, closed, top = seg + 1, [a + b for a, b in zip(closed, top, strict=True)], None
                    top = [max(0, x, y) for x, y in zip(now, top or [0] * 3, strict=True)]
                    last = now
                want = (seg, *([None] * 3 if top is None else [a + b for a, b in zip(closed, top, strict=True)]))
                assert got[r[:4]] == (pytest.approx(want) if top else want), (k, r, size)
