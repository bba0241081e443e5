"""Exact quantiles of a whole column without one task that holds it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges for each factor of e in a value, so each is under two percent wide. Doubles span about 90,000 of them, which
#: bounds the counts that reach the driver.
RANGES = 64


def exact_quantiles(frame: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Linearly interpolated quantiles of the non-null values; null without values.

    Counts by range say which ranges hold the wanted ranks; only the distinct values of those ranges are put in order.
    """
    values = frame.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL").groupBy("v").count()
    slot = F.floor(F.signum("v") * F.log1p(F.abs("v")) * RANGES).cast("int")
    placed = values.withColumn("slot", slot)
    counts = sorted((r["slot"], r["n"]) for r in placed.groupBy("slot").agg(F.sum("count").alias("n")).collect())
    n = sum(many for _, many in counts)
    if not n:
        return [None] * len(shares)
    wanted = sorted({r for s in shares for r in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))})
    before, slots = 0, {}
    for one, many in counts:
        for rank in wanted:
            if before <= rank < before + many:
                slots[one] = before
        before += many
    starts = F.create_map(*[F.lit(x) for item in slots.items() for x in item])
    ordered = Window.partitionBy("slot").orderBy("v")
    inside = placed.where(F.col("slot").isin(*slots)).withColumn("upto", F.sum("count").over(ordered) + starts[F.col("slot")])
    ranks = F.explode(F.filter(F.array(*[F.lit(r) for r in wanted]), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("count"))))
    found = {r["rank"]: r["v"] for r in inside.select("v", ranks.alias("rank")).collect()}
    out = []
    for share in shares:
        at = share * (n - 1)
        a, b = found[math.floor(at)], found[math.ceil(at)]
        out.append(a + (b - a) * (at - math.floor(at)))
    return out
