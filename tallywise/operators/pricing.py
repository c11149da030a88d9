"""Price lookup by approximate model name, and costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.plans.scale import join_checked, materialise

PRICES = ("input_cost_per_token", "output_cost_per_token", "cache_creation_cost_per_token", "cache_read_cost_per_token")
#: A trailing date of a model name; a fixed pattern.
DATE_SUFFIX = r"[-@]\d{8}$"
#: (tokens, price, cost) of the four parts of a cost.
PARTS = (
    ("input_tokens", "input_cost_per_token", "input_cost"),
    ("cache_creation_tokens", "cache_creation_cost_per_token", "cache_creation_cost"),
    ("cache_read_tokens", "cache_read_cost_per_token", "cache_read_cost"),
    ("output_tokens", "output_cost_per_token", "output_cost"),
)


def overlay(base: DataFrame, own: DataFrame, key: str = "model") -> DataFrame:
    """A user's catalog over a base: its entries replace those of the same key."""
    return own.unionByName(base.join(own.select(key), key, "left_anti"))


def _pieces(d: DataFrame, text: str, lengths: Sequence[int]) -> DataFrame:
    """``d`` with ``_piece``: every different piece of ``text`` that has one of the lengths."""
    size = F.length(text)
    cut = lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(F.col(text), i, n))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= size)
    return d.withColumn("_piece", F.explode(F.array_distinct(F.flatten(F.transform(fits, cut)))))


def match_models(names: DataFrame, catalog: DataFrame, name: str = "model", key: str = "model") -> DataFrame:
    """(name, tier, key, prices...) of each different name that a catalog entry matches.

    Tiers: equal; equal without the date suffix; equal regardless of case, with or
    without it; one contains the other regardless of case. The first tier that
    hits counts, then the longest key, then the greatest. Empty names match nothing.

    Each tier implies that one contains the other, so that all pairs come from equality
    joins: pieces of names that are as long as some key with keys, and pieces of keys
    that are as long as some name with names. Neither side is held against all of the other.
    """
    n = names.select(F.col(name).alias("_n")).where("_n <> ''").distinct()
    n = materialise(n.withColumns({"_s": F.regexp_replace("_n", DATE_SUFFIX, ""), "_a": F.lower("_n")}))
    c = catalog.select(F.col(key).alias("_k"), *PRICES).where("_k <> ''").dropDuplicates(["_k"]).withColumn("_l", F.lower("_k"))
    sizes = lambda d, t: sorted(r[0] for r in d.select(F.length(t)).distinct().collect())  # at most one row per length
    inside = _pieces(n, "_a", sizes(c, "_l")).join(c, F.col("_piece") == F.col("_l"))
    around = _pieces(c, "_l", sizes(n, "_a")).join(n, F.col("_piece") == F.col("_a"))
    cols = ["_n", "_s", "_a", "_k", "_l", *PRICES]
    hit = inside.select(*cols).unionByName(around.select(*cols))
    tier = F.when(F.col("_k") == F.col("_n"), 1).when(F.col("_k") == F.col("_s"), 2).when((F.col("_l") == F.col("_a")) | (F.col("_l") == F.lower("_s")), 3).otherwise(4)
    rank = F.struct(-tier, F.length("_k"), F.col("_k"))
    best = hit.groupBy("_n").agg(F.max_by(F.struct(tier.alias("tier"), F.col("_k").alias("matched"), *PRICES), rank).alias("_b"))
    return best.select(F.col("_n").alias(name), "_b.*")


def price(records: DataFrame, catalog: DataFrame, model: str = "model") -> DataFrame:
    """``records`` with four costs and their total; 0 where no price matches; null counters cost nothing."""
    m = materialise(match_models(records, catalog, model).select(model, F.struct(*PRICES).alias("_prices")))
    d = join_checked(records.drop("_prices"), m, [model])
    cost = lambda t, p: F.coalesce(F.col(t), F.lit(0)) * F.coalesce(F.col("_prices")[p], F.lit(0.0))
    d = d.withColumns({c: cost(t, p) for t, p, c in PARTS}).drop("_prices")
    return d.withColumn("total_cost", sum((F.col(c) for _, _, c in PARTS[1:]), F.col("input_cost")))


def unpriced(records: DataFrame, catalog: DataFrame, model: str = "model") -> DataFrame:
    """Different model names without a price."""
    return records.select(model).where(F.col(model).isNotNull()).distinct().join(match_models(records, catalog, model).select(model), model, "left_anti")
