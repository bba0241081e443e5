"""SimHash near-duplicates (operator 6).

Fingerprints of 64 bits are linked at two or fewer differing bits. A fingerprint is cut into two segments of
32 bits, so that of two linked ones the first segment differs in at most one bit, or else, with both
differences in the first, the second does not differ at all. The index therefore holds the first segment with
each of its bits in turn deleted, and the second whole: 33 keys for each distinct fingerprint. Equal keys join,
and the join's own condition counts the differing bits and admits a pair at one key only, so each link comes
out once. Equal texts share a fingerprint and are never paired.

A key that very many fingerprints share, as in a large group of near copies, would be quadratic. Its fingerprints
get other keys, all values at one bit or none from them: two within two bits have a value between them in common,
and no value has more than 65 fingerprints around it.

Texts without words, null ones too, have fingerprint zero and are linked like any other. Repeated rows are
kept. A null doc_id never names a component unless all its documents have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.components import connected
from tidewell.llm.textkit import chosen, groups, pieces, utf8_views, written

SHINGLE_WORDS = 3
SEED = 42

#: A key that more fingerprints have is left to the keys around them.
CROWD = 1024


def _hashes(words: list[bytes], width: int) -> list[int]:
    joined, starts, stops, at = b" ".join(words), [], [], 0
    for word in words:
        starts.append(at)
        at += len(word)
        stops.append(at)
        at += 1
    hash64 = xxhash.xxh64_intdigest
    return [hash64(joined[a:b], SEED) for a, b in zip(starts, stops[min(width, len(words)) - 1 :], strict=False)]


def shingle_hashes(text: bytes, width: int = SHINGLE_WORDS) -> Iterator[list[int]]:
    """XXH64 of each shingle, of the whole sequence if there are fewer words; in one list, of a long text in several."""
    last: list[bytes] = []
    some = False
    for piece in pieces(text):
        words = last + piece.lower().split()
        if len(words) >= width:
            some = True
            yield _hashes(words, width)
        last = words[1 - width :] if width > 1 else []
    if last and not some:
        yield _hashes(last, width)


def bit_sums(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes, how many have each of the 64 bits, the highest first."""
    out = np.zeros((len(counts), 64), np.int64)
    full = np.flatnonzero(counts)
    if len(full):
        lanes = np.unpackbits(hashes.astype(">u8").view(np.uint8)).view(np.uint64).reshape(-1, 8)
        first = np.concatenate(([0], np.cumsum(counts[full])))
        blocks = -(-counts[full] // 255)  # so many at most that a byte counts
        block_first = np.concatenate(([0], np.cumsum(blocks)))
        at = np.repeat(first[:-1] - 255 * block_first[:-1], blocks) + 255 * np.arange(block_first[-1])
        sums = np.add.reduceat(lanes, at, axis=0).view(np.uint8).reshape(-1, 64)
        out[full] = np.add.reduceat(sums.astype(np.int64), block_first[:-1], axis=0)
    return out


def majority(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit word for each row: the bits that are set in over half of the hashes; zero for none."""
    bits = (2 * sums > counts[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1).reshape(-1, 8).view(">u8").ravel().astype(np.uint64)


def fingerprint_of(text: bytes) -> int:
    """Of one text, however long."""
    sums, n = np.zeros((1, 64), np.int64), 0
    for found in shingle_hashes(text):
        sums += bit_sums(np.array(found, np.uint64), np.array([len(found)]))
        n += len(found)
    return int(majority(sums, np.array([n]))[0])


@F.arrow_udf(T.LongType())
def _fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        data, offsets = utf8_views(column)
        parts = [np.zeros(0, np.uint64)]
        for i, j in groups(offsets):
            if j == i + 1:
                parts.append(np.array([fingerprint_of(data[offsets[i] : offsets[j]].tobytes())], np.uint64))
                continue
            hashes = [next(shingle_hashes(data[a:b].tobytes()), []) for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True)]
            counts = np.array([len(h) for h in hashes], np.int64)
            parts.append(majority(bit_sums(np.array([x for h in hashes for x in h], np.uint64), counts), counts))
        yield pa.array(np.concatenate(parts).view(np.int64))


def fingerprint(text: Column) -> Column:
    """The fingerprint's bits as a signed long."""
    return _fingerprint(text)


def _paired(keyed: DataFrame, also: Column) -> DataFrame:
    near = F.bit_count(F.col("l.fingerprint").bitwiseXOR(F.col("r.fingerprint"))) <= 2
    pair = (F.col("l.key") == F.col("r.key")) & (F.col("l.fingerprint") < F.col("r.fingerprint")) & near & also
    return keyed.alias("l").join(keyed.alias("r").hint("merge"), pair).select(F.col("l.fingerprint").alias("a"), F.col("r.fingerprint").alias("b"))


def links(fingerprints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): each two of the distinct ``fingerprint`` values that differ in one or two bits, once, a < b."""
    low = F.col("fingerprint").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fingerprint", 32)
    deleted = [low.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i))).bitwiseOR(F.lit(i << 32)) for i in range(32)]
    keyed = fingerprints.select("fingerprint", F.explode(F.array(*deleted, high.bitwiseOR(F.lit(32 << 32)))).alias("key"))
    # counted before any rows of a key meet; most keys have one fingerprint and go no further. Spark takes the exploded rows
    # for as many bytes as the fingerprints and would send them all through the driver, so these joins are merges.
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sized = written(keyed.join(counts.hint("merge"), "key"))
    in_low = F.col("l.fingerprint").bitwiseXOR(F.col("r.fingerprint")).bitwiseAND(F.lit(0xFFFFFFFF))
    position = F.shiftrightunsigned(F.col("l.key"), 32)
    deleted_one = F.expr("shiftleft(1L, cast(shiftrightunsigned(l.key, 32) as int))")
    once = F.when(F.bit_count(in_low) > 1, position == 32).when(in_low == 0, position == 0).otherwise((position < 32) & (in_low == deleted_one))
    found = _paired(sized.where(F.col("n") <= crowd).select("fingerprint", "key"), once)
    crowded = written(sized.where(F.col("n") > crowd).select("fingerprint").distinct())
    if not crowded.limit(1).count():
        return found
    flipped = [F.col("fingerprint").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)]
    around = crowded.select("fingerprint", F.explode(F.array("fingerprint", *flipped)).alias("key"))
    return found.union(_paired(around, F.lit(True))).distinct()


def classes(marked: DataFrame) -> DataFrame:
    """(fingerprint, root, component_id) for each distinct fingerprint of ``marked`` (doc_id, fingerprint)."""
    distinct = written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")))
    stars = connected(links(distinct)).select(F.col("node").alias("fingerprint"), "root")
    rooted = distinct.join(stars, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    named = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(named, "root").select("fingerprint", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id (the smallest doc_id reachable over links) of each row."""
    marked = written(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fingerprint")))
    return marked.join(classes(marked), "fingerprint").select("doc_id", "fingerprint", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: of the smallest id, null last, then of the smallest hash of the text."""
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    marked = written(docs.select(F.col(id_col).alias("doc_id"), hashed.alias("hash"), fingerprint(F.col(text_col)).alias("fingerprint")))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    alike = marked.groupBy("fingerprint", "doc_id", "hash").count()
    first = alike.join(classes(marked), "fingerprint").groupBy("root").agg(F.min(F.struct(key.alias("key"), "count")).alias("first"))
    keep = written(first.select(F.col("first.key.doc_id").alias("of"), F.col("first.key.hash").alias("of_hash"), F.col("first.count").alias("rows")))
    return chosen(docs, id_col, text_col, keep).select("row.*")
