"""Window functions over groups of any size: local windows in range partitions, and carries.

Rows are range-partitioned on (keys, order) once and the partition number is
frozen. Every window then runs inside a partition; what a group brings over from
earlier partitions is added from a carry table. Only the first and last group of
a partition can reach beyond it, so a carry table has at most two rows a
partition, whatever the number and size of groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywise.plans.scale import dense_partitions, materialise

_PID = "__pid"


class Ordered:
    """A DataFrame in order within groups; methods return a new Ordered with columns added.

    ``order`` names columns that, with ``keys``, should be unique; ties are put in
    either order. Nulls sort first and are a group of their own. Without keys the
    whole table is one group.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]):
        self.keys, self.order = list(keys), list(order)
        self._all = dense_partitions(df, self.keys, [F.col(o) for o in self.order])
        low, high = self._all.agg(F.min(_PID), F.max(_PID)).first()
        #: Nothing is brought over where all rows came to lie in one partition.
        self._alone = low == high

    def _with(self, df: DataFrame) -> Ordered:
        out = object.__new__(Ordered)
        out.keys, out.order, out._alone, out._all = self.keys, self.order, self._alone, df
        return out

    @property
    def df(self) -> DataFrame:
        return self._all.drop(_PID)

    def with_columns(self, cols: Mapping[str, Column]) -> Ordered:
        return self._with(self._all.withColumns(dict(cols)))

    def freeze(self) -> Ordered:
        """The same, written once, so that the carries of later steps don't compute earlier steps again."""
        return self if self._alone else self._with(materialise(self._all))

    def _window(self, keys: Sequence[str]):
        return Window.partitionBy(_PID, *keys).orderBy(*[k for k in self.keys if k not in keys], *self.order)

    def lag(self, values: Sequence[str], prefix: str = "prev_") -> Ordered:
        """``<prefix><value>`` of the row before in the group, and ``_has_prev``."""
        d = self._all
        row = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(self.keys)], *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
        if self._alone:
            return self._with(self._previous(d.withColumn("_prev", F.lag(row).over(self._window(self.keys))), values, prefix))
        at = F.struct(*[F.col(c) for c in [*self.keys, *self.order]])
        last = d.groupBy(_PID).agg(F.max_by(row, at).alias("_last"))
        carry = materialise(last.select(_PID, F.lag("_last").over(Window.orderBy(_PID)).alias("_carry")))
        d = d.withColumn("_lag", F.lag(row).over(self._window(self.keys))).join(F.broadcast(carry), _PID, "left")
        same = F.col("_carry").isNotNull()
        for i, k in enumerate(self.keys):
            same = same & F.col(f"_carry.k{i}").eqNullSafe(F.col(k))
        d = d.withColumn("_prev", F.coalesce(F.col("_lag"), F.when(same, F.col("_carry"))))
        return self._with(self._previous(d, values, prefix).drop("_lag", "_carry"))

    @staticmethod
    def _previous(d: DataFrame, values: Sequence[str], prefix: str) -> DataFrame:
        names = {prefix + v: F.col(f"_prev.v{i}") for i, v in enumerate(values)}
        return d.withColumns({**names, "_has_prev": F.col("_prev").isNotNull()}).drop("_prev")

    def running(self, sums: Mapping[str, Column] | None = None, maxes: Mapping[str, Column] | None = None, within: Sequence[str] = ()) -> Ordered:
        """Running sums and maxima from the start of the group up to the row.

        ``within`` adds columns to the keys that never decrease along the order, such
        as a segment number. Nulls are skipped; before the first value a sum is 0 and
        a maximum is null.
        """
        keys = [*self.keys, *within]
        parts = [(o, c, F.sum) for o, c in (sums or {}).items()] + [(o, c, F.max) for o, c in (maxes or {}).items()]
        d = self._all.withColumns({f"_in_{o}": c for o, c, _ in parts})
        w = self._window(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if self._alone:
            d = d.withColumns({o: f(f"_in_{o}").over(w) for o, _, f in parts})
            d = d.withColumns({o: F.coalesce(F.col(o), F.lit(0).cast(d.schema[o].dataType)) for o, _, f in parts if f is F.sum})
            return self._with(d.drop(*[f"_in_{o}" for o, _, _ in parts]))
        group = F.struct(F.lit(0).alias("_"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
        per = d.groupBy(_PID, group.alias("_g")).agg(*[f(f"_in_{o}").alias(o) for o, _, f in parts])
        per = materialise(per)
        edge = per.groupBy(_PID).agg(F.min("_g").alias("_a"), F.max("_g").alias("_b"))
        per = per.join(F.broadcast(edge), _PID).where(F.col("_g").eqNullSafe(F.col("_a")) | F.col("_g").eqNullSafe(F.col("_b")))
        before = Window.partitionBy("_g").orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
        carry = materialise(per.select(_PID, F.col("_g").alias("_cg"), *[f(o).over(before).alias(f"_carry_{o}") for o, _, f in parts]))
        d = d.withColumns({f"_run_{o}": f(f"_in_{o}").over(w) for o, _, f in parts}).withColumn("_g", group)
        d = d.join(F.broadcast(carry.withColumnRenamed(_PID, "_cp")), (F.col(_PID) == F.col("_cp")) & F.col("_g").eqNullSafe(F.col("_cg")), "left")
        out = {}
        for o, c, f in parts:
            run, got = F.col(f"_run_{o}"), F.col(f"_carry_{o}")
            zero = F.lit(0).cast(d.schema[f"_run_{o}"].dataType)
            out[o] = F.coalesce(run, zero) + F.coalesce(got, zero) if f is F.sum else F.greatest(run, got)
        d = d.withColumns(out)
        return self._with(d.drop("_g", "_cg", "_cp", *[f"{p}{o}" for o, _, _ in parts for p in ("_in_", "_run_", "_carry_")]))
