import json
import random
from datetime import datetime, timedelta

from tallywise.operators import rescue as S

FILES = "file_id long, stream_id string, opened_at timestamp"


def line(**cost):
    return json.dumps({"ts": 1, "data": {"session_id": "s", "cost": {"total_cost_usd": 1.5, **cost}}})


def test_ingest_keeps_everything(spark):
    bodies = [
        line(total_lines_added=3, new_thing={"a": [1, 2]}), line(total_lines_added="7", total_lines_removed=2.5), '{"ts": "x", "other": null, "data": 5}', "", None,
        "{broken", "[1]", line(total_lines_added=None),
    ]
    df = spark.createDataFrame([(i, b, "c", 1) for i, b in enumerate(bodies)], "raw_id long, body string, _v string, total_lines_added int")
    d = {r["raw_id"]: r for r in S.ingest(df).collect()}
    assert [d[i]["_readable"] for i in range(8)] == [True, True, True, False, False, False, False, True]
    assert d[0]["total_lines_added"] == 3 and d[0]["_v"] == "c" and d[0]["_rescued"]["data.cost.new_thing"]["json"] == '{"a":[1,2]}'
    assert d[1]["total_lines_added"] is None and d[1]["_rescued"]["data.cost.total_lines_added"]["kind"] == "string"
    assert d[1]["_rescued"]["data.cost.total_lines_removed"]["json"] == "2.5" and d[1]["total_cost_usd"] == 1.5
    assert set(d[2]["_rescued"]) == {"ts", "other", "data"} and d[3]["_rescued"] is None
    p = {r["raw_id"]: r for r in S.promote(S.ingest(df)).collect()}
    assert p[1]["total_lines_added"] == 7 and p[1]["total_lines_added__kind"] == "string" and "data.cost.total_lines_added" not in p[1]["_rescued"]
    assert p[7]["total_lines_added__kind"] is None


def test_replay_of_names_and_objects(spark):
    bodies = [
        line(loc_added=4), line(lines_added={"count": 5}), json.dumps({"data": {"diff": {"insertions": 6.0}}}), line(added_lines="no number"),
        json.dumps({"message": {"usage": {"cache": {"creation": {"short_lived": 2, "long_lived": 3}}}}}),
    ]
    d = S.ingest(spark.createDataFrame(list(enumerate(bodies)), "raw_id long, body string"))
    p = S.promote(d, approved=S.approve(S.paths(d, "raw_id"))).orderBy("raw_id").collect()
    assert [r["total_lines_added"] for r in p] == [4, 5, 6, None, None] and p[4]["cache_creation_input_tokens"] == 5
    assert [r["total_lines_added__place"] for r in p[:4]] == ["data.cost.loc_added", "data.cost.lines_added", "data.diff.insertions", "data.cost.added_lines"]
    assert "data.cost.added_lines" in p[3]["_rescued"]


def test_report(spark):
    rnd = random.Random(2)
    t0 = datetime(2025, 1, 1)
    forms = [None, ("total_lines_added", 1), ("total_lines_added", 1.0), ("total_lines_added", {"count": 1}), ("loc_added", 1), ("loc_added", "1")]
    files, raw, shape = [], [], {}
    for f in range(240):
        stream = "hot" if f % 3 == 0 else f"s{f % 20}"
        files.append((f, stream, t0 + timedelta(hours=rnd.random() * 1000)))
        shape[f] = rnd.choice(forms)
        raw += [(f * 10 + k, f, b) for k, b in enumerate([line(), "{", line(**({shape[f][0]: shape[f][1]} if shape[f] else {}))])]
    want, before = set(), {}
    for f, s, _ in sorted(files, key=lambda x: (x[1], x[2])):
        if s in before:
            a, b = shape[before[s]], shape[f]
            if a and not b:
                want.add((f, "removed"))
            elif b and not a:
                want.add((f, "added"))
            elif a and b:
                want |= {(f, "renamed")} if a[0] != b[0] else set()
                want |= {(f, "retyped")} if type(a[1]) is not type(b[1]) else set()
        before[s] = f
    d = S.ingest(spark.createDataFrame(raw, "raw_id long, file_id long, body string"))
    p = S.promote(d, approved={"total_lines_added": ["data.cost.loc_added"]})
    got = S.drift_report(S.file_shapes(p), spark.createDataFrame(files, FILES))
    assert {(r["file_id"], r["change_kind"]) for r in got.collect()} == want
    none = S.drift_report(S.file_shapes(p.where("false")), spark.createDataFrame([], FILES))
    assert none.count() == 0


def test_names_in_other_words(spark):
    yes = "data.cost.linesAddedTotal data.diff.insertions data.lines.added data.cost.LOC_inserted data.cost.added-lines-count data.additions.lines".split()
    no = "data.cost.total_files_added data.lines_viewed data.cost.total_lines_added data.cost.lines message.lines_added data.lines.added.count data.cost.lines_added_today".split()
    added = next(t for t in S.LOG_LINES if t.name == "total_lines_added")
    assert [p for p in yes + no if S.names_target(p, added)] == yes
    assert S.words("a.totalLOCAdded_in-2 tage.Größe") == ["a", "total", "loc", "added", "in", "2", "tage", "gr", "öß", "e"]
    lines = [{"data": {"lines": {"added": 1}}}, {"message": {"cacheCreation": {"inputTokens": {"short_lived": 1}}}}, {"data": {"diff": {"deletions": None}}}, {"data": {"cost": {"added_lines": {"count": 2}}}}]
    d = S.ingest(spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)], "raw_id long, body string"))
    known = S.approve(S.paths(d, "raw_id"), more={"total_lines_removed": ["data.gone"]})
    assert known["total_lines_added"] == ["data.cost.added_lines", "data.lines.added"] and known["total_lines_removed"] == ["data.gone"]
    assert known["cache_creation_input_tokens"] == ["message.cacheCreation.inputTokens"] and S.approve(S.paths(d.where("false"), "raw_id"))["ts"] == []


def test_unknown_name_is_found_by_where_it_stands(spark):
    rnd = random.Random(4)
    t0 = datetime(2025, 1, 1)
    raw, files = [], []
    for f in range(200):
        files.append((f, f"s{f % 10}", t0 + timedelta(hours=f)))
        plus = f // 10 % 4 == 3
        cost = {"plusminus": {"up": f}} if plus else {"total_lines_added": f}
        if rnd.random() < 0.5:
            cost["other"] = 4
        raw += [(f, line(**cost, total_lines_removed=1)), (f, line())]
    d = S.ingest(spark.createDataFrame(raw, "file_id long, body string"))
    t = spark.createDataFrame(files, FILES)
    known = S.approve(S.paths(d))
    assert known["total_lines_added"] == []
    known = S.accept(S.candidates(d, t, approved=known), known)
    assert known["total_lines_added"] == ["data.cost.plusminus.up"] and known["total_lines_removed"] == []
    got = S.drift_report(S.file_shapes(S.promote(d, approved=known)), t)
    assert {r["change_kind"] for r in got.collect()} == {"renamed"}
    assert S.candidates(d.where("false"), t).count() == 0 and S.candidates(d, t.where("false")).count() == 0


def test_odd_lines():
    read = lambda b: S.read_line(b, S.LOG_LINES, frozenset({"data", "data.cost"}))
    assert read('{"a": NaN}') is None and read("[" * 100_000) is None and read('{"ts": 1') is None and read("") is None
    typed, rescued = read('{"ts": 99999999999999999999, "a\\ud800": "\\ud800", "type": true, "ts2": 1e5}')
    assert typed[0] is None and rescued == {"ts": ("integer", "99999999999999999999"), "a\\ud800": ("string", '"\\ud800"'), "type": ("boolean", "true"), "ts2": ("decimal", "100000.0")}
