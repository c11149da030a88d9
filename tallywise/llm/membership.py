"""Distinct counts over huge identifier sets by membership patterns.

Each identifier is reduced to the set of groups that contain it (its pattern);
identical patterns are counted; every count of a group, and of any union or
intersection of groups, follows exactly from the pattern totals. The stated
error is therefore zero.

The set of an identifier is cut into parts of bounded size, so that an identifier in
any number of groups is never one array: equal parts are numbered, and a pattern is
the list of its parts' numbers. An identifier in few groups has a single part.

Partial results are the states of :func:`state`: one row per identifier and
group. States of any parts of the records, overlapping or not, merge by
:func:`merge` without the records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywise.plans.scale import join_checked, materialise

#: Groups in a part of a set, about; sets are cut by a hash of the group into as many parts as they need.
PART_GROUPS = 512
#: Error bound of every count.
ERROR = 0.0


def state(df: DataFrame, identifier: str, groups: dict[str, Column]) -> DataFrame:
    """Partial result: distinct (id, one column per name of ``groups``).

    A null identifier is none. A null group is a group of its own. Duplicates are
    dropped before the shuffle, so that a hot identifier or group sends one row a
    task for each combination.
    """
    return df.select(F.col(identifier).alias("id"), *[c.alias(k) for k, c in groups.items()]).where("id is not null").distinct()


def merge(*states: DataFrame) -> DataFrame:
    """The state of all parts together."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.distinct()


def patterns(st: DataFrame) -> DataFrame:
    """(pattern_id, parts, groups array<struct<groups>>, n): the patterns, a row for each part, and how many identifiers have each.

    How a set is cut depends on its size and its groups alone, so equal sets are cut
    alike and patterns are equal exactly if their parts are. Parts are numbered by the
    table that lists the different ones, so nothing rests on hashes being free of
    collisions.
    """
    names = [c for c in st.columns if c != "id"]
    st = materialise(st)
    size = st.groupBy("id").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > PART_GROUPS)
    size = size.select("id", F.ceil(F.col("_k") / PART_GROUPS).cast("int").alias("parts"))
    g = F.struct(*names)
    d = join_checked(st, materialise(size), ["id"]).withColumn("parts", F.coalesce("parts", F.lit(1)))
    d = d.groupBy("id", "parts", F.pmod(F.xxhash64(*names), F.col("parts")).alias("_at")).agg(F.array_sort(F.collect_list(g)).alias("groups"))
    one = d.where("parts = 1").groupBy("parts", "groups").agg(F.count(F.lit(1)).alias("n"))
    many = materialise(d.where("parts > 1"))
    part = materialise(many.select("parts", "_at", "groups").distinct().withColumn("_no", F.monotonically_increasing_id()))
    lists = many.join(part, ["parts", "_at", "groups"]).groupBy("id").agg(F.array_sort(F.collect_list("_no")).alias("_nos"))
    whole = lists.groupBy("_nos").agg(F.count(F.lit(1)).alias("n")).withColumn("_p", F.monotonically_increasing_id())
    whole = materialise(whole).select("_p", "n", F.explode("_nos").alias("_no")).join(part, "_no")
    # Numbers of patterns of one part and of several don't meet: odd and even.
    one = one.select((F.monotonically_increasing_id() * 2).alias("pattern_id"), "parts", "groups", "n")
    return one.unionByName(whole.select((F.col("_p") * 2 + 1).alias("pattern_id"), "parts", "groups", "n"))


def counts(pat: DataFrame, grains: dict[str, Sequence[str]], distinct: str = "n_ids") -> DataFrame:
    """(grain, groups..., n): exact distinct counts at each grain from pattern totals.

    A pattern counts once for each different value of the grain's columns in it.
    Columns that a grain lacks are null. ``grains`` maps a name to columns.
    """
    types = {f.name: f.dataType for f in pat.schema["groups"].dataType.elementType.fields}
    names = list(types)

    def keys(p: Column) -> Column:
        out = []
        for grain, cols in grains.items():
            one = lambda e, grain=grain, cols=cols: F.struct(
                F.lit(grain).alias("grain"), *[(e[c] if c in cols else F.lit(None).cast(types[c])).alias(c) for c in names]
            )
            out.append(F.array_distinct(_each(p, one)))
        return F.concat(*out)

    one = pat.where("parts = 1").select("n", F.explode(keys(F.col("groups"))).alias("k")).groupBy("k").agg(F.sum("n").alias("n"))
    # Parts of one pattern may share a key, which counts once.
    many = pat.where("parts > 1").select("pattern_id", "n", F.explode(keys(F.col("groups"))).alias("k")).distinct().groupBy("k").agg(F.sum("n").alias("n"))
    return one.unionByName(many).groupBy("k").agg(F.sum("n").alias(distinct)).select("k.*", distinct)


def _each(p: Column, f) -> Column:
    return F.transform(p, lambda e: f(e))


def combination(pat: DataFrame, any_of: Column | None = None, all_of: Sequence[Column] = ()) -> DataFrame:
    """One row (n): identifiers in some group that fits ``any_of`` and, for each of ``all_of``, in some group that fits it.

    The conditions are over the group columns. Exact, from pattern totals alone.
    """
    names = pat.schema["groups"].dataType.elementType.fieldNames()
    conds = [*([any_of] if any_of is not None else []), *all_of]
    # Written first: a task that is run again might number its patterns otherwise.
    d = materialise(pat).select("pattern_id", "n", F.explode("groups").alias("_g")).select("pattern_id", "n", *[F.col(f"_g.{c}").alias(c) for c in names])
    hits = [F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(f"_h{i}") for i, c in enumerate(conds)]
    d = d.groupBy("pattern_id", "n").agg(F.count(F.lit(1)).alias("_c"), *hits)
    for i in range(len(conds)):
        d = d.where(F.col(f"_h{i}") == 1)
    return d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
