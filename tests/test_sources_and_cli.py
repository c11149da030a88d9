import base64
import json

import pytest

from tallywise import options
from tallywise.cli import main
from tallywise.operators import status
from tallywise.render import grid as G
from tallywise.render import values as V
from tallywise.render import views
from tallywise.render.chart import chart
from tallywise.render.clipboard import osc52
from tallywise.sources import prices, transcripts
from tallywise.sources.status import load_status


def message(key, out, at="2025-10-01T10:00:00Z", **more):
    use = {"input_tokens": 5, "output_tokens": out}
    content = [{"type": "tool_use", "name": "B"}, {"type": "tool_use", "name": "A"}, {"type": "text"}, {"type": "tool_use", "name": "B"}]
    return json.dumps({"type": "assistant", "requestId": f"r{key}", "timestamp": at, "message": {"id": f"m{key}", "model": "abc-1", "usage": use, "content": content}} | more)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    a, b = root / "projects/-home-me-x", root / "projects/plain/_hidden/subagents"
    a.mkdir(parents=True)
    b.mkdir(parents=True)
    lines = [message(1, 1), "", "  ", "{bad", message(1, 9), message(2, 3, None), message(3, -1), message(4, 2.5), message(5, 1, type="summary"), message(6, 1, timestamp=1759312800000)]
    (a / "s 1+.jsonl").write_text("\n".join(lines) + "\r\n")
    (b / "agent.jsonl").write_text(message(1, 9) + "\n" + message(7, 1, 1759312800) + "\n")
    (a / "broken.jsonl").write_bytes(message(8, 1).encode() + b"\xff\n")
    (a / "empty.jsonl").write_text("")
    status = [
        {"ts": 1759000000 + i * 900, "data": {
            "session_id": f"s{i // 3}", "workspace": {"project_dir": "/a/b/c"}, "model": {"id": "m"},
            "cost": {"total_cost_usd": i % 3, "total_duration_ms": 1000 * (i % 3), "total_api_duration_ms": 5}, "context_window": {"context_window_size": 1},
            "rate_limits": {"five_hour": {"used_percentage": 2.5 + i, "resets_at": 1759010000}, "seven_day": {"used_percentage": 1, "resets_at": 1759200000}}}}
        for i in range(6)
    ]
    bad = [{"ts": 1}, {**status[0], "ts": 1.5}, {"ts": 1, "data": {**status[0]["data"], "version": None}}]
    (root / "status.jsonl").write_text("\n".join(map(json.dumps, status + bad)) + "\n{\n\n")
    (root / "prices.json").write_text(json.dumps({"fetchedAt": "2025-01-01", "models": {"abc": {"inputCostPerToken": 0.5, "outputCostPerToken": 1}}}))
    return root


def test_load_usage(spark, tree):
    rows = {(r["session_id"], r["line_no"]): r for r in transcripts.load_usage(spark, str(tree)).collect()}
    # Message 1 was delivered twice with as many tokens; the later file stays. Message 2 follows no timestamp in its file.
    assert set(rows) == {("s 1+", 4), ("s 1+", 8), ("agent", 1), ("agent", 2)}
    assert rows["agent", 1]["output_tokens"] == 9 and rows["agent", 1]["agent_id"] == "agent" and rows["s 1+", 8]["project"] == "/home/me/x"
    assert rows["s 1+", 8]["tool_names"] == "A, B" and str(rows["agent", 2]["record_timestamp"]) == "2025-10-01 10:00:00" and rows["s 1+", 4]["cache_read_tokens"] == 0
    assert transcripts.load_usage(spark, str(tree), project="PLAIN", session="gen").count() == 2
    assert transcripts.load_usage(spark, str(tree / "projects")).count() == 0


def test_load_status(spark, tree):
    d, n = load_status(spark, str(tree / "status.jsonl"))
    assert tuple(n.first()) == (6, 4) and [r["five_hour_used_percentage"] for r in d.orderBy("snap_id").collect()] == [3, 4, 5, 6, 7, 8]
    d, n = load_status(spark, str(tree / "gone.jsonl"))
    assert d.count() == 0 and tuple(n.first()) == (0, 0)


def test_strict_lines(spark):
    from tallywise.functions.json import Field, fits, kind, parse

    assert [kind(x) for x in (1, 1.0, True, None, "", {}, [], 1 << 63, float("inf"))] == ["integer", "decimal", "boolean", None, "string", "object", "array", "decimal", "too large"]
    assert all(parse(x) is None for x in (None, "", "[1]", "{", '{"a": NaN}', '{"a": 1, "a": 2}', '{"b": {"a": 1, "a": 2}}', "[" * 90_000, "null")) and parse('{"a": 1}') == {"a": 1}
    rule = lambda **k: [(Field("a.b", ("integer",), **k), ("a", "b"))]
    assert fits({}, rule()) and fits({"a": 3}, rule()) and fits({"a": {"b": None}}, rule()) and fits({"a": {"b": -1}}, rule())
    assert not any((fits({}, rule(need=True)), fits({"a": {"b": None}}, rule(null=False)), fits({"a": {"b": -1}}, rule(count=True)), fits({"a": {"b": 1.0}}, rule()), fits({"a": {"b": True}}, rule())))
    odd = [message(1, 1, "2025-10-01"), message(2, 1, 1e300), message(3, 1, True), message(4, 1, "x", createdAt=1759312800.5), json.dumps({"message": {"content": [{"type": "tool_use", "name": 3}]}}), json.dumps({"message": {"content": "a"}}), '{"requestId": "\\ud800"}', ""]
    df = spark.createDataFrame([("/p", None, i, x) for i, x in enumerate(odd)], "file_path string, modified_at timestamp, line int, body string")
    got = {r["line"]: r for r in transcripts.parse_lines(df).collect()}
    assert set(got) == {0, 1, 3, 5, 6} and got[0]["record_timestamp"] is None and got[1]["record_timestamp"] is None and got[6]["request_id"] == "\\ud800"
    assert str(got[3]["record_timestamp"]) == "2025-10-01 10:00:00.500000" and got[3]["tool_names"] == "A, B" and got[5]["tool_names"] == ""


def test_replacement_character_is_no_broken_file(spark, tree, tmp_path):
    a = tmp_path / "projects/p"
    a.mkdir(parents=True)
    odd = json.dumps({"type": "assistant", "message": {"content": "\ufffd"}}, ensure_ascii=False)
    (a / "valid.jsonl").write_text(odd + "\n" + message(1, 1) + "\n", encoding="utf-8")
    for i, part in enumerate((b"\xff", b"\xed\xa0\x80", b"\xe2\x82")):
        (a / f"broken{i}.jsonl").write_bytes(message(2 + i, 1).encode() + b"\n" + part + b"\n" + odd.encode() + b"\n")
    assert [(r["session_id"], r["line_no"]) for r in transcripts.load_usage(spark, str(tmp_path)).collect()] == [("valid", 2)]
    lines = (tree / "status.jsonl").read_bytes()
    (tmp_path / "status.jsonl").write_bytes(lines + "\ufffd\n".encode())
    d, n = load_status(spark, str(tmp_path / "status.jsonl"))
    assert d.count() == 6 and tuple(n.first()) == (6, 5)
    (tmp_path / "status.jsonl").write_bytes(lines + b"\xff\n")
    assert tuple(load_status(spark, str(tmp_path / "status.jsonl"))[1].first()) == (0, 0)


def test_prices(spark, tree):
    c, at = prices.load_catalog(spark, str(tree / "prices.json"))
    assert at == "2025-01-01" and tuple(c.first()) == ("abc", 0.5, 1.0, 0.0, 0.0)
    live = {"x/m@1-v2:0": {"input_cost_per_token": 1}, "x/m-1": {"input_cost_per_token": 2}, "y/z": {"input_cost_per_token": 1}, "x/n": {"input_cost_per_token": "1"}, "x/o": 3}
    assert prices.normalise_live(live, ["x/"]) == {"m-1": [2, 0.0, 0.0, 0.0]}


@pytest.mark.parametrize(
    "args,parts",
    [
        (["--pricing-data", "{}/prices.json", "--cost", "decimal", "--tz", "UTC", "--table", "full"], ["2025-10-01", "└─ abc-1", "TOTAL", "($"]),
        (["--per", "model", "--output", "markdown", "--filename", "-", "--table", "compact"], ["| Model | In Total | Out | Total |", "**TOTAL**"]),
        (["--per", "project", "--per", "tool", "--output", "json", "--filename", "-"], ['"children"', '"dedup"', '"label": "A, B"']),
        (["--per", "line", "--chart", "token"], ["┤", "└"]),
    ],
)
def test_reports(spark, tree, capsys, args, parts):
    assert main(["--log-dir", str(tree), *[a.format(tree) for a in args]], spark) == 0
    out = capsys.readouterr().out
    assert all(p in out for p in parts)


@pytest.mark.parametrize(
    "args,parts",
    [
        ([], ["Window", "Est 5h Budg"]), (["--per", "session", "--output", "csv", "--filename", "-"], ["Session,Cost", "s0,$2", "TOTAL,$4"]),
        (["--per", "action", "--tz", "+05:30", "--table", "full"], ["5h Resets", "3%"]), (["--per", "day", "--output", "json", "--filename", "-"], ['"view": "day"', '"totalCostUsd"']),
        (["--per", "1h", "--output", "html", "--filename", "-"], ["<table>", "5h Resets"]), (["--per", "session", "--cost-diff"], ["unmatched"]),
        (["--per", "session", "--cost-diff", "--output", "json", "--filename", "-"], ['"totals"', '"unmatchedCount": 2', '"computed": null']), (["--nopromo", "--copy", "csv"], ["Window"]), (["--chart", "cost"], ["$"]),
    ],
)
def test_status_views(spark, tree, capsys, args, parts):
    assert main(["sl", "--file", str(tree / "status.jsonl"), "--log-dir", str(tree), *args], spark) == 0
    out = capsys.readouterr()
    assert all(p in out.out for p in parts) and "6 loaded, 4 malformed" in out.err


@pytest.mark.parametrize("form,head", [("csv", "Session,Cost,Duration,API Time,Lines,Segments,"), ("tsv", "\tSegments\t"), ("markdown", "| Segments |")])
def test_status_headers_are_long(spark, tree, capsys, form, head):
    assert main(["sl", "--file", str(tree / "status.jsonl"), "--per", "session", "--table", "full", "--output", form, "--filename", "-"], spark) == 0
    assert head in capsys.readouterr().out.splitlines()[0]


def test_every_error_is_reported_at_once(capsys):
    assert main(["--order", "up", "--table", "x", "--cost", "y", "--copy", "banana", "--chart", "z", "--output", "w", "--live-pricing"]) == 1
    err = capsys.readouterr().err
    assert [x.split(":")[0] for x in err.splitlines() if ": invalid value" in x] == ["--order", "--table", "--cost", "--copy", "--output", "--chart"]
    assert "--live-pricing needs --pricing-url" in err and "Valid: json, markdown, html, txt, csv, tsv" in err
    assert main(["--live-pricing", "--pricing-url", "u", "--provider", "p", "--pricing-data", "f"]) == 1 and "exclude" in capsys.readouterr().err
    for v in ("-v", "--version"):
        with pytest.raises(SystemExit) as e:
            main([v])
        assert e.value.code == 0 and "tallywise" in capsys.readouterr().out


def test_copy_has_its_own_format(spark, tree, capsys, tmp_path):
    out = tmp_path / "o.json"
    assert main(["--log-dir", str(tree), "--per", "model", "--output", "json", "--filename", str(out), "--copy", "markdown"], spark) == 0
    err = capsys.readouterr().err
    assert "copied markdown" in err and json.loads(out.read_text())["data"]
    assert base64.b64decode(err.split("52;c;")[1].split("\x07")[0]).decode().startswith("| Model |")


def test_catalogs_lie_over_each_other(spark, tree, capsys, tmp_path):
    (tmp_path / "own.json").write_text(json.dumps({"models": {"abc": {"outputCostPerToken": 2}, "x": {}}}))
    args = ["--log-dir", str(tree), "--per", "model", "--cost", "decimal", "--output", "csv", "--filename", "-", "--table", "compact"]
    assert main([*args, "--pricing-data", f"{tree}/prices.json", "--pricing-data", f"{tmp_path}/own.json"], spark) == 0
    got = capsys.readouterr()
    # 9 + 3 + 1 + 1 output tokens at 2, input free; the date is that of the first file.
    assert "($28.00)" in got.out and "prices of 2025-01-01" in got.err


def test_folder_as_url(spark, tree):
    url = f"file://{tree}"
    assert transcripts.roots(url, spark) == [f"{url}/projects"] and transcripts.roots(url + "/none", spark) == []
    assert transcripts.load_usage(spark, url).count() == 4


def test_raw_numbers(spark, tree):
    d, _ = load_status(spark, str(tree / "status.jsonl"))
    a = G.to_csv(views.raw_actions([r.asDict() for r in status.actions(d).orderBy("snap_id").collect()])).splitlines()
    s = G.to_csv(views.raw_sessions([r.asDict() for r in status.sessions(d).orderBy("session_id").collect()])).splitlines()
    assert a[0] == "Time,Cost,5h%,1w%,5h Resets,1w Resets,Session" and a[2].split(",")[1:4] == ["1.000000", "4", "1"] and a[1].endswith(",s0")
    assert s[1] == "s0,/a/b/c,2.000000,2s,0s,0,0,,1"
    g = G.Grid(["A", "B"], [["x", "1"]], [["TOTAL", "\x1b[33m1\x1b[0m"]])
    assert json.loads(G.to_json(g)) == [{"A": "x", "B": "1"}, {"A": "TOTAL", "B": "1"}] and "TOTAL" not in G.box(G.without_totals(g)) and json.loads(G.render(g, "json"))


def test_validation(capsys):
    assert main(["--per", "x", "--per", "day", "--per", "day", "--from", "1.1.25", "--5hfrom", "2025-01-01", "--5hto", "2025-01-01", "--chart", "cost", "--output", "csv"]) == 1
    assert len(capsys.readouterr().err.splitlines()) == 6
    assert options.date_range("a", "b", {"5hto": "2025-01-01 05:00", "1wfrom": "2025-01-01"}) == ("2025-01-01T00:00:00", "2025-01-01T05:00:00")
    assert options.date_range("a", "b", {"5hto": "2025-13-01"}) == ("a", "b")
    assert options.zone("utc") == "UTC" and options.zone("+5:30") == "+05:30" and options.zone("Europe/Berlin") == "Europe/Berlin" and options.zone("No/Where") == options.zone(None)


def test_values_and_grids():
    assert [V.tokens(x) for x in (999, 1000, 1_234_567)] == ["999", "1.0K", "1.23M"] and V.cost(2.5) == "$3" and V.cost(1.005, "decimal") == "$1.00" and V.cost(-2.5) == "$-3"
    assert V.duration(3_720_000) == "1h 2m" and V.duration(62_000) == "1m 2s" and V.project("/a/b/c/d") == ".../c/d" and V.span(1, 2) == "1–2%" and V.span(None, 2) == "—"
    g = G.Grid(["A", "Sess"], [["x,\"y", "1"], ["└─ t\tb", "2"]], [["TOTAL", "3|"]])
    assert G.to_csv(g).splitlines()[1] == '"x,""y",1' and G.to_tsv(g).splitlines()[2] == "└─ t\\tb\t2" and '"x,""y"' in G.to_tsv(g, True)
    assert "3\\|" in G.to_markdown(g) and "<th>Sessions</th>" in G.to_html(g, "<t>") and "&lt;t&gt;" in G.to_html(g, "<t>")
    assert len({len(x) for x in G.box(g).replace("\t", " ").splitlines()}) == 1 and osc52("a").startswith("\x1b]52;c;YQ==")
    assert chart([], []) == "No data to chart." and len(chart(["2025-01-01", "2025-01-02"], [0, 5]).splitlines()) == 17
