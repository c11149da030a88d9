"""Reported against computed cost per session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.plans.scale import materialise

#: Shortest prefix of an id that may stand for it, in the exploded join.
LEAST_PREFIX = 1


def match_ids(left: DataFrame, right: DataFrame, key: str = "session_id") -> DataFrame:
    """(left id, right id): equal ids, else of all pairs where one is a prefix of the other the one with the longest common part, then the greatest.

    Ids without a partner have a null. Prefix pairs come from equality joins on each
    id's own prefixes of lengths that the other side has, so ids are never compared
    all with all. Null ids match nothing; an empty id is no prefix.
    """
    a = materialise(left.select(F.col(key).alias("_a")).distinct())
    b = materialise(right.select(F.col(key).alias("_b")).where("_b is not null").distinct())
    exact = a.join(b, F.col("_a") == F.col("_b"))
    rest = a.join(exact.select("_a"), "_a", "left_anti")
    sizes = lambda d, c: sorted(r[0] for r in d.select(F.length(c)).distinct().collect() if (r[0] or 0) >= LEAST_PREFIX)  # at most one row per length

    def cut(d: DataFrame, c: str, lengths: list[int]) -> DataFrame:
        fits = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n < F.length(c))
        return d.withColumn("_p", F.explode(F.transform(fits, lambda n: F.substring(F.col(c), F.lit(1), n))))

    long_a = cut(rest, "_a", sizes(b, "_b")).join(b.withColumnRenamed("_b", "_p2"), F.col("_p") == F.col("_p2")).select("_a", F.col("_p2").alias("_b"))
    long_b = cut(b, "_b", sizes(rest, "_a")).join(rest, F.col("_p") == F.col("_a")).select("_a", "_b")
    near = long_a.unionByName(long_b)
    best = near.groupBy("_a").agg(F.max(F.struct(F.least(F.length("_a"), F.length("_b")).alias("n"), F.col("_b").alias("b")))["b"].alias("_b"))
    found = exact.unionByName(best)
    return a.join(found, "_a", "left").select(F.col("_a").alias(key), F.col("_b").alias("matched_id"))


def cost_diff(reported: DataFrame, computed: DataFrame, key: str = "session_id", cost: str = "total_cost_usd", own: str = "total_cost") -> DataFrame:
    """Each reported session with its computed cost, the difference, and that in per cent of the computed (null near 0)."""
    m = match_ids(reported, computed, key).select(F.col(key).alias("_id"), "matched_id").where("_id is not null")
    d = reported.join(m, F.col(key) == F.col("_id"), "left").drop("_id")
    c = computed.select(F.col(key).alias("_id"), F.col(own).alias("computed_cost")).where("_id is not null")
    d = d.join(c, F.col("matched_id") == F.col("_id"), "left").drop("_id").withColumn("diff", F.col(cost) - F.col("computed_cost"))
    big = F.abs("computed_cost") > 1e-9
    return d.withColumn("diff_pct", F.when(big, F.col("diff") / F.when(big, F.col("computed_cost")) * 100))


def diff_totals(d: DataFrame, cost: str = "total_cost_usd") -> DataFrame:
    """One row: totals of the matched sessions, and how many weren't."""
    ok = F.col("matched_id").isNotNull()
    t = d.agg(
        F.coalesce(F.sum(F.when(ok, F.col(cost))), F.lit(0.0)).alias("reported"), F.coalesce(F.sum(F.when(ok, F.col("computed_cost"))), F.lit(0.0)).alias("computed"),
        F.count_if(ok).alias("matched"), F.count_if(~ok).alias("unmatched"),
    )
    t = t.withColumn("diff", F.col("reported") - F.col("computed"))
    return t.withColumn("diff_pct", F.when(F.col("computed") > 0, F.col("diff") / F.when(F.col("computed") > 0, F.col("computed")) * 100))
