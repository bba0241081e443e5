"""Near-duplicates of the pipeline: SimHash links (operator 6), completed by MinHash fingerprints (operator 1).

Two texts are linked if their sets of SHINGLE_WORDS-word shingles have a Jaccard similarity of 0.8 or more. SimHash
alone cannot find them: at 0.8 two 64-bit fingerprints differ in 10 bits on average, and an index of segments with one
wildcard loses all selectivity there. So its links at two bits, which find the closest copies, are followed by bands
of a one-permutation MinHash fingerprint: sets that agree in all ROWS bins of one of BANDS bands are candidates, which
a pair of similarity 0.8 misses with probability (1 - 0.8 ** ROWS) ** BANDS = 3e-6.

Both only propose. A pair whose packed fingerprints show a likeness under LEAST_LIKENESS (eight standard errors below 0.8)
is left out, and every other one is decided on the two whole sets.

Texts with equal sets are one row before any join. A group of k near copies has k * k / 2 pairs, so its members are
compared with leads first: in each round (ROUNDS, one) every key that still has members of different components picks one
of them by a hash, and only pairs with it are decided. Keys differ in their picks, so a member meets several leads a
round. Of keys that still have several components, members of different ones are then compared exactly, block by block
inside a task, at the smallest key that the two have in common; only alike pairs come out. No pair that shares a band
is left undecided, and no task holds more than two blocks.

Shingles are those of simhash: ASCII lower case, the whole sequence if there are fewer words. Texts without words,
null ones too, are one group. Components follow links, so two of their texts may be less alike than 0.8. Repeated rows
are one document; other columns pass through. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm import minhash, simhash
from tidewell.llm.components import connected
from tidewell.llm.textkit import chosen, groups, utf8_views, written

SHINGLE_WORDS = 5
BANDS, ROWS = 32, 5
LEAST_LIKENESS = 0.65

#: Rounds of comparisons with leads, and different orders in which keys pick them.
ROUNDS, LEADS = 1, 8

#: Bytes of shingle hashes that a block holds, on average; one set at least.
BLOCK_BYTES = 1 << 20

LONGS = T.ArrayType(T.LongType())
MARKS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("fingerprint", T.LongType()),
        T.StructField("bands", LONGS),
        T.StructField("sketch", T.BinaryType()),
    ]
)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def _hashes_between(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """All shingle hashes of each text, repeats included."""
    for a, b in zip(offsets, offsets[1:], strict=False):
        yield np.concatenate([np.zeros(0, np.uint64), *[np.array(x, np.uint64) for x in simhash.shingle_hashes(data[a:b].tobytes(), SHINGLE_WORDS)]])


@F.arrow_udf(LONGS)
def _shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        yield _lists([np.unique(found.view(np.int64)) for found in _hashes_between(*utf8_views(column))])


def shingles(text: Column) -> Column:
    """The sorted distinct hashes of the text's shingles."""
    return _shingles(text)


def described(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the shingle hashes of each text: hash of the set, SimHash, keys of the MinHash bands, packed MinHash."""
    counts = np.array([len(t) for t in texts], np.int64)
    hashes = np.concatenate([np.zeros(0, np.uint64), *texts])
    ids = np.array([xxhash.xxh64_intdigest(np.unique(t).tobytes()) for t in texts], np.uint64)
    fingerprints = simhash.majority(simhash.bit_sums(hashes, counts), counts)
    # a text without shingles has one bin, of zero
    filled = np.insert(minhash.mixed(hashes), np.concatenate(([0], np.cumsum(counts)))[:-1][counts == 0], np.uint64(0))
    bins = minhash.densified(minhash.binned(filled, np.maximum(counts, 1)))
    keys = np.zeros((len(texts), BANDS), np.uint64)
    for row in range(ROWS):
        keys = minhash.mixed(keys + bins[:, row * BANDS : (row + 1) * BANDS] + np.arange(BANDS, dtype=np.uint64))
    return ids, fingerprints, keys, minhash.low_bits(bins)


@F.arrow_udf(MARKS)
def _marks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        data, offsets = utf8_views(column)
        parts = [described([])]
        parts += [described(list(_hashes_between(data, offsets[i : j + 1]))) for i, j in groups(offsets)]
        ids, marks, bands, sketches = (np.concatenate(x) for x in zip(*parts, strict=True))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel().view(np.int64)))
        packed = pa.array([row.tobytes() for row in sketches], pa.binary())
        yield pa.StructArray.from_arrays([pa.array(ids.view(np.int64)), pa.array(marks.view(np.int64)), lists, packed], MARKS.names)


@F.arrow_udf(T.DoubleType())
def _likeness(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = (np.frombuffer(b"".join(side.to_pylist()), np.uint8).reshape(len(side), -1) for side in (a, b))
    return pa.array(minhash.likeness(x, y))


def _decided(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of 0.8 or more."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for end in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(end), F.col("sketch").alias(f"sketch_{end}")), end)
    near = written(pairs.where(_likeness("sketch_a", "sketch_b") >= LEAST_LIKENESS).select("a", "b"))
    ends = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
    wanted = written(sets.join(ends, "id", "left_semi").select("id", F.col("first.doc_id").alias("of"), F.col("first.hash").alias("of_hash"), F.lit(1).alias("rows")))
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash"))).select("id", "text").dropDuplicates(["id"])
    found = written(texts.select("id", shingles(F.col("text")).alias("found")))
    both = near
    for end in "ab":
        both = both.join(found.select(F.col("id").alias(end), F.col("found").alias(f"found_{end}")), end)
    shared = F.size(F.array_intersect("found_a", "found_b"))
    return written(both.where(9 * shared >= 4 * (F.size("found_a") + F.size("found_b"))).select("a", "b"))


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows (id, ...) with the ``root`` of their component."""
    return rows.join(connected(links).select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def _close(sets: DataFrame) -> DataFrame:
    """(a, b) of sets that SimHash links: those of one fingerprint with their first, and the firsts of two linked ones."""
    leads = written(sets.groupBy("fingerprint").agg(F.min("id").alias("lead")))
    same = sets.join(leads, "fingerprint").where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    near = simhash.links(leads.select("fingerprint"))
    for end in "ab":
        near = near.join(leads.select(F.col("fingerprint").alias(end), F.col("lead").alias(f"lead_{end}")), end)
    return same.union(near.select("lead_a", "lead_b"))


def _apart(members: DataFrame) -> DataFrame:
    """The rows (id, key, root) of keys that have several roots; a merge, as Spark counts exploded bands as one."""
    several = members.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    return members.join(several.hint("merge"), "key", "left_semi")


@F.arrow_udf(T.BinaryType())
def _packed_shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        yield pa.array([np.unique(found).tobytes() for found in _hashes_between(*utf8_views(column))], pa.binary())


class Block:
    """Members of one key: ids, roots, sizes, bands and their sorted hashes, one after the other."""

    def __init__(self, items: list[dict]):
        self.ids, self.roots = (np.array([x[c] for x in items], np.int64) for c in ("id", "root"))
        self.found = [np.frombuffer(x["found"], np.uint64) for x in items]
        self.sizes = np.array([len(f) for f in self.found], np.int64)
        self.bands = np.array([x["bands"] for x in items], np.int64)


def alike_between(key: int, left: Block, right: Block, same: bool) -> Iterator[tuple[int, int]]:
    """Alike pairs of members of different components whose smallest common band is the key; of one block each pair once."""
    for i, bands in enumerate(left.bands):
        n = left.sizes[i]
        fits = (right.roots != left.roots[i]) & (5 * right.sizes >= 4 * n) & (5 * n >= 4 * right.sizes)
        if same:
            fits[: i + 1] = False
        others = np.flatnonzero(fits)
        common = np.where(right.bands[others] == bands, bands, np.iinfo(np.int64).max)
        others = others[common.min(axis=1, initial=np.iinfo(np.int64).max) == key]
        if not len(others):
            continue
        hashes = np.concatenate([right.found[j] for j in others])
        at = np.searchsorted(left.found[i], hashes)
        held = np.append(left.found[i], np.uint64(0))[at] == hashes
        held &= at < n
        ends = np.cumsum(right.sizes[others])
        sums = np.concatenate(([0], np.cumsum(held)))
        shared = sums[ends] - sums[ends - right.sizes[others]]
        for j in others[9 * shared >= 4 * (n + right.sizes[others])]:
            yield int(min(left.ids[i], right.ids[j])), int(max(left.ids[i], right.ids[j]))


PAIRS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


@F.arrow_udf(PAIRS)
def _alike_pairs(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for keys, same, lefts, rights in batches:
        rows = []
        for k in range(len(keys)):
            left, right = Block(lefts[k].as_py()), Block(rights[k].as_py())
            rows.append([{"a": a, "b": b} for a, b in alike_between(keys[k].as_py(), left, right, same[k].as_py())])
        yield pa.array(rows, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))


def _across(members: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the alike pairs among members (id, key, root) of one key and different components."""
    wanted = written(sets.join(members.select("id").distinct(), "id", "left_semi").select("id", "bands", F.col("first.doc_id").alias("of"), F.col("first.hash").alias("of_hash")))
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash"))).select("id", "text", "bands").dropDuplicates(["id"])
    found = written(texts.select("id", "bands", _packed_shingles("text").alias("found")))
    many = members.join(found.select("id", F.length("found").alias("size")), "id").groupBy("key").agg(F.ceil(F.sum("size") / BLOCK_BYTES).alias("blocks"))
    placed = members.join(many, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.greatest("blocks", F.lit(1)))).drop("blocks")
    items = placed.join(found, "id")  # sets come last, so that they are shuffled once on their way to blocks
    blocks = written(items.groupBy("key", "block").agg(F.collect_list(F.struct("id", "root", "found", "bands")).alias("items")))
    pairs = blocks.alias("l").join(blocks.alias("r").hint("merge"), (F.col("l.key") == F.col("r.key")) & (F.col("l.block") <= F.col("r.block")))
    alike = _alike_pairs(F.col("l.key"), F.col("l.block") == F.col("r.block"), F.col("l.items"), F.col("r.items"))
    return written(pairs.select(F.explode(alike).alias("pair")).select("pair.*"))


def links(docs: DataFrame, sets: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(a, b), pairs of alike ``sets`` that show their components.

    sets: id, fingerprint, bands, sketch and first (doc_id and hash of a text that has it); docs: doc_id, hash and text.
    """
    keyed = sets.select("id", F.explode("bands").alias("key"))
    members = written(_apart(keyed.withColumn("root", F.col("id"))))
    alike = None
    for turn in range(rounds):
        order = F.xxhash64("id", F.lit(turn), F.pmod("key", F.lit(LEADS)))
        leads = members.groupBy("key").agg(F.min(F.struct(order.alias("order"), F.col("id").alias("lead"), F.col("root").alias("of"))).alias("pick"))
        stars = members.join(leads.select("key", "pick.lead", "pick.of").hint("merge"), "key").where("root <> of").select(F.col("lead").alias("a"), F.col("id").alias("b"))
        new = _decided(stars if alike is not None else _close(sets).union(stars), docs, sets)
        alike = new if alike is None else alike.union(new)
        members = written(_apart(_rooted(members.select("id", "key"), alike).select("id", "key", "root")))
    return alike.union(_across(members, docs, sets))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: of the smallest id, null last, then of the smallest hash of the text."""
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(F.col(id_col).alias("doc_id"), hashed.alias("hash"), F.col(text_col).alias("text"))
    marked = written(texts.select("doc_id", "hash", _marks("text").alias("marks")).select("doc_id", "hash", "marks.*"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    same = [F.any_value(c).alias(c) for c in ("fingerprint", "bands", "sketch")]
    sets = written(marked.groupBy("id").agg(F.min(key).alias("first"), *same))
    alike = marked.groupBy("id", "doc_id", "hash").count()
    rooted = _rooted(alike, links(texts, sets))
    first = rooted.groupBy("root").agg(F.min(F.struct(key.alias("key"), "count")).alias("first"))
    keep = written(first.select(F.col("first.key.doc_id").alias("of"), F.col("first.key.hash").alias("of_hash"), F.col("first.count").alias("rows")))
    return chosen(docs, id_col, text_col, keep).select("row.*")
