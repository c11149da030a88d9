import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallywise.plans import scale
from tallywise.operators import records as R
from tallywise.streaming import records as S

SCHEMA = "id long, m string, r string, v long"


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, rnd.choice("abc"), rnd.choice(["x", None]), rnd.randint(0, 3)) for i in range(90)]
    for k in range(3):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.best_copies(stream, ["m", "r"], "v", ["id"]).writeStream.format("memory").queryName("best").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = R.keep_max(spark.createDataFrame(rows, SCHEMA).where("r is not null"), ["m", "r"], "v", ["id"])
    assert {r["id"] for r in spark.table("best").collect()} == {r["id"] for r in want.collect()}


def test_windows_into_a_table(spark, tmp_path):
    spark.sql("select timestamp'2025-01-01 00:10:00' + make_interval(0,0,0,0,id,0,0) record_timestamp, 'm' model, 1L input_tokens, 2L output_tokens from range(60)").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("record_timestamp timestamp, model string, input_tokens long, output_tokens long").parquet(str(tmp_path / "in"))
    S.to_table(S.usage_by_window(s), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    d = spark.read.parquet(str(tmp_path / "out"))
    # The last record is of 11:10 on the third day: hours that end by 11:10 of the first are closed.
    assert d.count() == 11 and d.agg({"output_tokens": "sum"}).first()[0] == 22


def test_catalogue():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and {f"p{n}_found" for n in (1, 2, 3, 5)} <= set(q) and len(sql) >= 50


def test_written_tables_are_deleted(spark):
    d = scale.materialise(spark.range(9).withColumn("x", F.col("id") * 2))
    path = scale._WRITTEN[-1].path
    assert d.agg({"x": "sum"}).first()[0] == 72 and os.path.isdir(path.removeprefix("file:"))
    assert scale.clean() >= 1 and not os.path.exists(path.removeprefix("file:")) and scale.clean() == 0


def test_no_temporary_folder_on_a_cluster():
    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scale.checkpoint_dir(Session)


def test_core_does_not_import_the_subpackage():
    base = os.path.join(os.path.dirname(entry.__file__), "tallywise")
    for d, _, names in os.walk(base):
        if os.path.relpath(d, base).split(os.sep)[0] != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "tallywise.llm" not in open(os.path.join(d, n), encoding="utf-8").read(), n


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_plans(spark):
    d = "/root/testdata/sf0.001"
    plan = lambda n: entry.queries()[n](spark, d)._jdf.queryExecution().executedPlan().toString()
    one = plan("p1_found")
    assert "Exchange" not in one and "Python" not in one and "ReadSchema: struct<record_id:bigint,tool_names:string>" in entry.queries()["p1_found"](spark, d)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "BroadcastHashJoin" in plan("cost_lines") and "Exchange hashpartitioning" not in plan("cost_lines") and "Cartesian" not in plan("p2_found")
    assert entry.entry(spark).count() > 0
