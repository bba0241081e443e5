"""Line dedup (operator 7) by a deletion-neighbourhood join.

A line is dropped if the same line, or one within EDITS = 1 insertions, deletions or substitutions of a
character, stands earlier in the corpus: in a row of smaller doc_id, or before it in the same text. The earliest of
equal lines is compared for all of them, and a line that is itself dropped still drops later ones. Only blank lines
are always kept: any line of LEAST_CHARS = 1 characters or more is compared, so a line of one character that is not
the corpus's first such line goes.

Emitting every one-deletion variant of every line would multiply the corpus by the mean line length. Two lines
within one edit share their first half or their last half, so keys of halves come first, by built-in functions;
only lines that share one with another line go on, with their text, to keys of the line without one of PARTS parts, and
of these again only lines that share one to the neighbourhood: one key for the line and one for each character
deleted, by rolling sums in linear time. Lines with an equal key join, and Levenshtein's distance
decides. Variants of one key differ in one place only, so a key holds few lines however many copies there are.

Every join here shuffles unless Spark itself finds a side small in bytes; nothing is hinted, so plans are alike at every size.

Null texts stay null. Rows without id come last; rows of one id go by their text's hash. Of repeated rows (equal id and
text) one counts as the first, and the others lose every line that is not blank. A text whose lines all go becomes
empty; the row stays. Only the named id and text are read; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.rules import let
from tidewell.llm.textkit import carried, written

EDITS = 1
LEAST_CHARS = 1

#: A character that makes a line more than blank.
VISIBLE = "[^\\x20\\x09-\\x0D]"

#: Parts of a line that are left out in turn before single characters are.
PARTS = 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, no, line, h1, h2) of the lines that may be dropped; th is the text's hash, h1 and h2 the line's."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.posexplode(F.split(text_col, "\n")).alias("no", "line"))
    rows = rows.where((F.length("line") >= LEAST_CHARS) & F.col("line").rlike(VISIBLE))
    return rows.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _line_id() -> Column:
    return F.xxhash64("h1", "h2")


def _half_keys() -> Column:
    """Keys of the first and last characters, as many as half a line's or half of one character more."""
    n = F.length("line")
    keys = []
    for size in (F.floor(n / 2).cast("int"), F.floor((n + 1) / 2).cast("int")):
        keys += [F.xxhash64(F.lit("first"), F.substring(F.col("line"), F.lit(1), size)), F.xxhash64(F.lit("last"), F.substring(F.col("line"), n - size + 1, size))]
    return F.array_distinct(F.array(*keys))


def _part_keys() -> Column:
    """Keys of the line without each of PARTS parts, cut for its own length and for that of a line longer by one."""
    n = F.length("line")

    def without(longer: int) -> Column:
        size = n + longer

        def key(j: Column) -> Column:
            front = F.floor(j * size / PARTS).cast("int")
            back = size - F.floor((j + 1) * size / PARTS).cast("int")
            return F.xxhash64(size, j, F.substring(F.col("line"), F.lit(1), front), F.substring(F.col("line"), n - back + 1, back))

        return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), key)

    return F.concat(without(0), without(1))


def _sharing(keyed: DataFrame) -> DataFrame:
    """id of the rows (id, key) whose key another id has too."""
    shared = keyed.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("key")
    return keyed.join(shared, "key", "left_semi").select("id").distinct()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def deletion_keys(line: str) -> np.ndarray:
    """Hashes of the line without one of its characters, with the place, and of those that another line could be.

    Two kinds of key tell equal length from a length that differs by one: for a substitution the place that is
    left out must agree, for an insertion the longer line's rest must be the shorter line.
    """
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(points)
    steps = np.full(n + 1, _BASE)
    steps[0] = 1
    power = np.multiply.accumulate(steps)
    front = np.concatenate((np.zeros(1, np.uint64), np.cumsum(points * power[:n], dtype=np.uint64)))
    # what follows the place moves down by one: compared after a shift of all the front by one step
    rest = front[:n] * _BASE + (front[n] - front[1:])
    size = np.array([n], np.uint64)
    places = np.arange(n, dtype=np.uint64)
    same = _mix(_mix(rest + size * _C1) + places * _C2 + np.uint64(1))
    shorter = _mix(_mix(rest + (size - np.uint64(1)) * _C1) + np.uint64(2))
    whole = _mix(_mix(front[n : n + 1] * _BASE + size * _C1) + np.uint64(2))
    return np.unique(np.concatenate((same, shorter, whole)))


KEYED = T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.LongType())])


def _neighbourhood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, size = [], [], 0
        for one, line in zip(batch.column("id").to_pylist(), batch.column("line").to_pylist(), strict=True):
            keys.append(deletion_keys(line))
            ids.append(np.full(len(keys[-1]), one, np.int64))
            size += len(keys[-1])
            if size > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys).view(np.int64))], names=KEYED.names)
                ids, keys, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys).view(np.int64))], names=KEYED.names)


def _place() -> Column:
    """Where a line stands: rows without id last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "no")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, gone): the sorted line numbers that go, for each row that loses some."""
    found = lines(docs, id_col, text_col)
    marks = found.select("h1", "h2", _place().alias("place"), F.length("line").alias("n"), _half_keys().alias("halves"))
    distinct = written(marks.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("copies"), F.any_value("halves").alias("halves")))
    candidates = _sharing(distinct.select(_line_id().alias("id"), F.explode("halves").alias("key")))
    at = ["h1", "h2"]
    wanted = written(distinct.withColumn("id", _line_id()).join(candidates, "id", "left_semi").select("id", *at, "first"))
    texts = found.join(wanted, at).where(_place() == F.col("first")).dropDuplicates(at)
    texts = written(texts.select("id", *at, "first", "line"))
    closer = _sharing(texts.select("id", F.explode(_part_keys()).alias("key")))
    texts = written(texts.join(closer, "id", "left_semi"))
    keyed = written(texts.select("id", "line").repartition("id").mapInArrow(_neighbourhood, KEYED))
    pairs = keyed.alias("l").join(keyed.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.id") < F.col("r.id")))
    pairs = pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    left = texts.select(F.col("id").alias("a"), F.col("line").alias("line_a"), F.col("first").alias("first_a"), F.struct(*at).alias("key_a"))
    right = texts.select(F.col("id").alias("b"), F.col("line").alias("line_b"), F.col("first").alias("first_b"), F.struct(*at).alias("key_b"))
    # lines may be long and yet small on disk, so they are never broadcast
    close = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(F.levenshtein("line_a", "line_b", EDITS) >= 0)
    near = close.select(F.when(F.col("first_a") > F.col("first_b"), F.col("key_a")).otherwise(F.col("key_b")).alias("key")).select("key.*").distinct()
    near = near.withColumn("near", F.lit(True))
    repeated = distinct.join(near, at, "left").where("near OR copies > 1")
    repeated = written(repeated.select(*at, "first", F.coalesce("near", F.lit(False)).alias("near")))
    gone = found.select(*at, "doc_id", "th", "no", _place().alias("place")).join(repeated, at).where(F.col("near") | (F.col("place") != F.col("first")))
    return gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("no")).alias("gone"))


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """carried() with ``again``: true for all but one of the rows that have an id and a text in common."""
    rows = carried(docs, id_col, text_col)
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash"))
    counts = rows.groupBy("doc_id", "hash").count().where("count > 1")
    repeated = written(counts.select(F.col("doc_id").alias("of"), F.col("hash").alias("of_hash")))
    if not repeated.limit(1).count():
        return rows.withColumn("again", F.lit(False))
    # numbered in a table of their own, so that a row keeps its number when it is read again
    numbered = written(rows.join(repeated, same).withColumn("number", F.monotonically_increasing_id()))
    first = numbered.groupBy("of", "of_hash").agg(F.min("number").alias("number")).select("number", F.lit(True).alias("first"))
    numbered = numbered.join(first, "number", "left").select("row", "doc_id", "text", "hash", F.col("first").isNull().alias("again"))
    return rows.join(repeated, same, "left_anti").withColumn("again", F.lit(False)).union(numbered)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the kept lines in text, and n_lines and n_dropped, as longs; columns of those names are replaced."""
    gone = written(dropped_lines(docs, id_col, text_col))
    gone = gone.select(F.col("doc_id").alias("of"), F.col("th").alias("of_hash"), "gone")
    rows = _marked(docs, id_col, text_col)
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash")), "left")
    cut = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("gone"))
    kept = let(F.struct(cut.alias("lines"), left.alias("left")), lambda x: F.transform(x["left"], lambda no: F.get(x["lines"], no)))
    blank = F.filter(cut, lambda line: ~line.rlike(VISIBLE))
    stays = F.when(F.col("again"), blank).when(F.col("gone").isNotNull(), kept).otherwise(cut)
    changed = F.when(F.col("again") | F.col("gone").isNotNull(), F.array_join(stays, "\n")).otherwise(F.col("text"))
    dropped = F.when(F.col("again"), F.size(cut) - F.size(blank)).otherwise(F.size("gone"))
    counts = {"n_lines": F.coalesce(F.size(cut), F.lit(0)).cast("long"), "n_dropped": F.coalesce(dropped, F.lit(0)).cast("long")}
    new = counts | {text_col: F.when(F.col("text").isNotNull(), changed)}
    return joined.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns], *[v.alias(n) for n, v in counts.items() if n not in docs.columns])
