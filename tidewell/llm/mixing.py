"""Mixing sources to target weights (operator 10) by Efraimidis-Spirakis sampling.

Targets share all words by the sources' weights, and none exceeds MOST_EPOCHS times its source: the excess goes
to the others by weight until none is above. A source's target is taken as complete epochs of all its documents
first. For what is left, each document draws an exponential key divided by its quality weight; in the order of
the keys, a document is taken while the larger part of its words lies within the budget, so a source's words miss
its target by half a document at most.

A document's quality weight follows from statistics of the quality rules: its share of lines that repeat none before
them, and its symbols a character. Another weight, such as a classifier's score, can be given instead.

The draw is a hash of the document's id and text, so reruns agree. Nulls: a null text has no words and nothing
is taken of it; a null source is a source of its own, the last. Ties in the key go by id, then by the text's hash.
Repeated rows are documents of their own with equal keys, taken one by one while the budget lasts; as they are
equal, it makes no difference which of them the budget cuts off. Sources without words have target 0 and an empty
table gives no rows. A null weight, or one that is not positive, counts as LEAST_WEIGHT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.lines import VISIBLE
from tidewell.llm.rules import SYMBOLS, let
from tidewell.llm.textkit import WORD_SEPARATORS, written

# Weights of the sources by code point, repeating, and the most often that a document is taken.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3

#: Key ranges to each doubling of the key. As at most 0.26 of a source's keys lie within one doubling, whatever their
#: weights, a range holds about 1 in 4,000 of its documents.
RANGES = 1024

LEAST_WEIGHT = 0.1


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SEPARATORS), "")).cast("long")


def quality_weight(text: Column) -> Column:
    """Between LEAST_WEIGHT and 1: the share of lines that repeat no earlier one, less ten times the share of symbols."""
    text = F.coalesce(text, F.lit(""))
    symbols = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))) / F.greatest(F.length(text), F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(VISIBLE))
    new = let(lines, lambda x: F.size(F.array_distinct(x)) / F.greatest(F.size(x), F.lit(1)))
    return F.greatest(F.lit(LEAST_WEIGHT), new - 10 * symbols)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) for each row of ``sizes`` (source, source_size), one a source.

    With limits c = most_epochs * source_size the targets are min(c, level * weight) for the one level at which they
    add up to all words. In the order of c / weight the limited sources come first, so running sums find the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    position = F.row_number().over(by_name) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), position % len(weights) + 1))
    weighed = weighed.withColumn("limit", (F.col("source_size") * most_epochs).cast("double"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    found = weighed.select(
        "*",
        F.coalesce(F.sum("limit").over(so_far), F.lit(0.0)).alias("below"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(so_far), F.lit(0.0))).alias("rest"),
        F.sum("source_size").over(everything).alias("total"),
        F.row_number().over(order).alias("rank"),
    )
    level = (F.col("total") - F.col("below")) / F.col("rest")
    open_level = F.min(F.when(level * F.col("weight") <= F.col("limit"), F.struct("rank", level.alias("level")))).over(everything)["level"]
    return found.select("source", "source_size", F.least("limit", F.coalesce(open_level * F.col("weight"), F.col("limit"))).alias("target"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, weight: Column | None, *also: Column) -> DataFrame:
    """doc_id, source, size, hash, key, range and ``also`` of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.coalesce(quality_weight(F.col(text_col)) if weight is None else weight, F.lit(0.0)).alias("weight"),
        F.xxhash64(text).alias("hash"),
        *also,
    )
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "hash"), 11) + 0.5) / 2**53
    rows = rows.withColumn("key", -F.log(draw) / F.when(F.col("weight") > 0, F.col("weight")).otherwise(LEAST_WEIGHT))
    return rows.withColumn("range", F.floor(F.log2("key") * RANGES)).drop("weight")


def _ends(rows: DataFrame) -> DataFrame:
    """of (a source), source_size, target, epochs, budget, the range ``end`` in which the budget ends, and the words before it."""
    sums = written(rows.groupBy("source", "range").agg(F.sum("size").alias("words")))
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = goal.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = goal.withColumnRenamed("source", "of")
    walked = sums.join(goal, F.col("source").eqNullSafe(F.col("of")))
    running = F.sum("words").over(Window.partitionBy("of").orderBy("range"))
    walked = walked.withColumn("after", running).withColumn("before", F.col("after") - F.col("words"))
    last = F.when(F.col("before") <= F.col("budget"), F.struct("range", "before"))
    ends = walked.groupBy("of", "source_size", "target", "epochs", "budget").agg(F.max(last).alias("end"))
    return written(ends.select("of", "source_size", "target", "epochs", "budget", F.col("end.range").alias("end"), F.col("end.before").alias("before")))


def _at_the_edge(joined: DataFrame) -> DataFrame:
    """The rows of the ranges in which budgets end, with ``more``: whether the budget reaches them."""
    order = Window.partitionBy("source").orderBy("key", "doc_id", "hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.sum("size").over(order) + F.col("before")
    return joined.where(F.col("range") == F.col("end")).withColumn("more", reached - F.col("size") / 2 <= F.col("budget"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, weight: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, and ``hash`` (of the text), for each row; ``weight`` replaces quality_weight().

    A source's documents never meet in one task: sums by source and key range come first, and they tell in which
    range the budget ends; only that range's rows are put in order. The ends, one row a source, are a table of their own.
    """
    rows = written(_keyed(docs, id_col, text_col, source_col, seed, weight))
    joined = rows.join(_ends(rows), F.col("source").eqNullSafe(F.col("of")))
    clear = joined.where(F.col("range") != F.col("end")).withColumn("more", F.col("range") < F.col("end"))
    taken = F.col("size") * (F.col("epochs") + F.when(F.col("more"), 1).otherwise(0))
    return clear.unionByName(_at_the_edge(joined)).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "hash")


def drawn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, weight: Column | None = None) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken; rows without words are left out.

    Texts are not shuffled: a row's range tells how often it is taken, and only those of the ranges in which budgets
    end, one in some 4,000, are looked up in a table.
    """
    rows = written(_keyed(docs, id_col, text_col, source_col, seed, weight))
    ends = _ends(rows)
    edge = _at_the_edge(rows.join(ends, F.col("source").eqNullSafe(F.col("of"))))
    edge = edge.groupBy("source", "doc_id", "hash").agg(F.sum(F.col("epochs") + F.when(F.col("more"), 1).otherwise(0)).alias("at_edge"), F.count("*").alias("rows"))
    edge = written(edge.select(F.col("source").alias("edge_source"), F.col("doc_id").alias("edge_id"), F.col("hash").alias("edge_hash"), "at_edge", "rows"))
    found = _keyed(docs, id_col, text_col, source_col, seed, weight, F.struct(*docs.columns).alias("row")).drop("key")
    found = found.join(ends, F.col("source").eqNullSafe(F.col("of")))
    listed = F.col("source").eqNullSafe(F.col("edge_source")) & F.col("doc_id").eqNullSafe(F.col("edge_id")) & (F.col("hash") == F.col("edge_hash"))
    found = found.join(edge, listed, "left")
    clear = F.col("epochs") + F.when(F.col("range") < F.col("end"), 1).otherwise(0)
    times = F.when(F.col("size") > 0, F.coalesce("at_edge", clear)).otherwise(0)
    found = found.withColumn("times", times.cast("int")).where("times > 0")
    if edge.where("rows > 1").limit(1).count():
        found = found.where("rows IS NULL OR rows = 1").union(found.where("rows > 1").dropDuplicates(["source", "doc_id", "hash"]))
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
