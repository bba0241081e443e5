"""Ranks within groups of any size: a group's rows are numbered by ranges, not in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a group's values; each is put in order by itself.
SLOTS = 512


def _spread(value: Column) -> Column:
    """Keeps the order, and spreads values that crowd near zero."""
    value = value.cast("double")
    return F.signum(value) * F.log1p(F.abs(value))


def numbered(frame: DataFrame, keys: list[str], value: str, ties: list[Column] | None, name: str, descending: bool = False) -> DataFrame:
    """frame with ``name``: the row number by value within keys, nulls last, then by ``ties``; without ties the rank.

    Counts by range of values, a few hundred rows a group, give what stands before a range; rows are ordered within
    their range only.
    """
    edges = frame.groupBy(*keys).agg(F.min(_spread(F.col(value))).alias("_low"), F.max(_spread(F.col(value))).alias("_high"))
    at = F.floor((_spread(F.col(value)) - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-300)) * SLOTS)
    slot = F.least(at, F.lit(SLOTS - 1))
    slot = F.when(F.col(value).isNull(), SLOTS).otherwise(F.lit(SLOTS - 1) - slot if descending else slot).cast("int")
    same = lambda a, b, names: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    placed = frame.alias("f").join(edges.alias("e"), same("f", "e", keys)).select("f.*", "e._low", "e._high").withColumn("_slot", slot).drop("_low", "_high")
    counts = placed.groupBy(*keys, "_slot").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    order = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
    window = Window.partitionBy(*keys, "_slot").orderBy(order, *(ties or []))
    rank = F.row_number() if ties else F.rank()
    found = placed.alias("f").join(before.alias("e"), same("f", "e", [*keys, "_slot"])).select("f.*", "e._before")
    return found.withColumn(name, (rank.over(window) + F.col("_before")).cast("long")).drop("_slot", "_before")
