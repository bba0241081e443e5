"""Connected components of a link table, without a vertex's links ever meeting in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.textkit import written


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for each end of ``links`` (a, b: two different longs); root is the smallest node of its component.

    Alternates two star contractions until nothing changes, about log(longest path) rounds. Each round is a
    grouped minimum, which is combined before the shuffle, and a join, which adaptive execution can split on a
    hot node. Each round's links are written to the shared folder, so a lost executor costs one round at most.
    No links give no rows.
    """
    links = written(links)
    before = None
    while True:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        links = written(small.union(least).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
