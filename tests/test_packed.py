import random

from tallywise.operators.packed import explode_packed

NAMES = ["ReadFile", "fs/list", "Search, Web", "Say \"Hi\"", "O'Hara Lint", "Tab\tSplit", "Plan|Review", "Zip + Ship", "Ask User", "Übersetze", "a\\b", "0"]


def split(spark, texts, **k):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, tools string, value string")
    out = {i: [] for i in range(len(texts))}
    for r in sorted(explode_packed(df, "id", "tools", **k).collect(), key=lambda r: (r["id"], r["pos"])):
        out[r["id"]].append(r["value"])
        assert r["pos"] == len(out[r["id"]])
    return [out[i] for i in range(len(texts))]


def test_forms(spark):
    got = split(
        spark,
        [
            None, "", "  ", "[]", "a", "a, b", "a;b|c\td\ne", "a  b c", "Ask User, b", '["a", "b, c"]', "['x', 'y']", "{a,\"b c\",d}", 'a, , "b"', ", a, a",
            "a & b + c · d / e", "fs/list, x/y", "a、b，c", "a\r\nb", "'O''Hara', \"say \"\"hi\"\"\"", "Search\\, Web, b", "it's, fine", '"open, b', 'git /', '"", a',
            '["\\u00dcb", "t\\tb"]', "a + + b",
        ],
    )
    assert got == [
        [], [], [], [], ["a"], ["a", "b"], ["a", "b", "c", "d", "e"], ["a", "b", "c"], ["Ask User", "b"], ["a", "b, c"], ["x", "y"], ["a", "b c", "d"], ["a", "b"],
        ["a", "a"], ["a", "b", "c", "d", "e"], ["fs/list", "x/y"], ["a", "b", "c"], ["a", "b"], ["O'Hara", 'say "hi"'], ["Search, Web", "b"], ["it's", "fine"],
        ['"open', "b"], ["git"], ["a"], ["Üb", "t\tb"], ["a", "b"],
    ]


def test_round_trip(spark):
    rnd = random.Random(5)
    rows = [[rnd.choice(NAMES) for _ in range(rnd.randint(2, 6))] for _ in range(300)]
    quote = [lambda x: '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"', lambda x: "'" + x.replace("\\", "\\\\").replace("'", "''") + "'"]
    texts = [rnd.choice([", ", ",", " | ", ";", "\n"]).join(rnd.choice(quote)(x) for x in r) for r in rows]
    assert split(spark, texts) == rows


def test_single_values_and_long_text(spark):
    long = ",".join(f'"v {i}"' for i in range(20_000))
    got = split(spark, ["a", '"a b"', "a,b", long], keep_single=False)
    assert got[:3] == [[], [], ["a", "b"]] and len(got[3]) == 20_000 and got[3][-1] == "v 19999"


def test_empty_table_and_null_key(spark):
    df = spark.createDataFrame([], "id long, tools string")
    assert explode_packed(df, "id", "tools").count() == 0
    df = spark.createDataFrame([(None, "a b"), (None, "a b")], "id long, tools string")
    assert explode_packed(df, "id", "tools").count() == 4
