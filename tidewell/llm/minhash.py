"""One-permutation MinHash fingerprints (operator 1).

Every five-word shingle of a text is hashed once. The hash's high bits choose one of BINS bins, the rest
compete for the bin's minimum. An empty bin copies the first full bin on a probe sequence that depends on the
bin and the attempt only (optimal densification), so equal texts have equal fingerprints. The low BITS bits of
each bin are kept, packed, as lowercase hex. Two fingerprints agree in a bin by chance with probability
2**-BITS, which the likeness subtracts.

Null texts count as empty. A text without words has one shingle, the empty one; a text of fewer than five words
has one, all its words. The next document is the one with the largest smaller doc_id, null ids come last, and
rows of one id go by their text's hash; after the last one comes the first. A lone document follows itself.
Repeated rows are kept and follow each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.textkit import GROUP_BYTES, pieces, utf8_views, written

SHINGLE_WORDS = 5
BINS = 512
BITS = 4

#: Sampled ids for each section.
PICKS = 16

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**k and its inverse, modulo 2**64, for k < n at least."""
    if len(_powers[0]) < n:
        for at, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _powers[at] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each text) for the texts that edges cut data into."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SEPARATOR[data]
    starts = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    joints = edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < len(data))]
    starts[joints] = inside[1:-1][joints]
    stops[joints - 1] = inside[1:-1][joints - 1]
    starts, stops = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    power, inverse = _power_tables(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)))
    hashes = mixed((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64) * _C2)
    return hashes, np.diff(np.searchsorted(starts, edges))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, shingles of each text); one at least for each text."""
    padded = np.maximum(counts, width)
    filled = np.zeros(int(padded.sum()), np.uint64)
    first = np.concatenate(([0], np.cumsum(padded)))
    own = np.concatenate(([0], np.cumsum(counts)))
    filled[np.arange(len(words)) + np.repeat(first[:-1] - own[:-1], counts)] = words
    many = padded - width + 1
    rolled = np.zeros(max(0, len(filled) - width + 1), np.uint64)
    for k in range(width):
        rolled = mixed(rolled + filled[k : len(filled) - width + 1 + k] + np.uint64(k + 1))
    starts = np.concatenate(([0], np.cumsum(many)))
    at = np.arange(starts[-1]) + np.repeat(first[:-1] - starts[:-1], many)
    return rolled[at], many


_probes: list[np.ndarray] = []


def _probe(attempt: int) -> np.ndarray:
    while len(_probes) <= attempt:
        seeds = np.arange(BINS, dtype=np.uint64) + np.array([len(_probes) * BINS + 1], np.uint64) * _C1
        _probes.append((mixed(mixed(seeds)) % np.uint64(BINS)).astype(np.int64))
    return _probes[attempt]


EMPTY = np.uint64(2**64 - 1)


def binned(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The least hash in each bin of each text; EMPTY in bins that none fell in."""
    bins = np.full(len(counts) * BINS, EMPTY)
    text = np.repeat(np.arange(len(counts)), counts)
    at = text * BINS + (shingles >> np.uint64(64 - (BINS - 1).bit_length())).astype(np.int64)
    np.minimum.at(bins, at, shingles & np.uint64((1 << (64 - (BINS - 1).bit_length())) - 1))
    return bins.reshape(-1, BINS)


def densified(bins: np.ndarray) -> np.ndarray:
    """bins with the EMPTY ones filled; one bin at least of each text is full."""
    full = bins != EMPTY
    out = bins.copy()
    rows, columns = np.nonzero(~full)
    attempt = 0
    while len(rows):
        source = _probe(attempt)[columns]
        found = full[rows, source]
        out[rows[found], columns[found]] = bins[rows[found], source[found]]
        rows, columns, attempt = rows[~found], columns[~found], attempt + 1
    return out


def low_bits(bins: np.ndarray) -> np.ndarray:
    """The low bits of densified bins: a row of BINS * BITS / 8 bytes for each text."""
    low = (mixed(bins) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    bits = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - BITS :]
    return np.packbits(bits.reshape(len(bins), BINS * BITS), axis=1)


def packed(bins: np.ndarray) -> np.ndarray:
    """Densified low bits of binned() texts."""
    return low_bits(densified(bins))


def _words(text: bytes) -> np.ndarray:
    return word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]


def _binned_in_pieces(text: bytes) -> np.ndarray:
    """binned() of one long text; a piece takes the last words of the one before it along."""
    bins, last = np.full((1, BINS), EMPTY), np.zeros(0, np.uint64)
    for piece in pieces(text):
        words = np.concatenate((last, _words(piece)))
        if len(words) >= SHINGLE_WORDS:
            bins = np.minimum(bins, binned(*shingle_hashes(words, np.array([len(words)]))))
        last = words[1 - SHINGLE_WORDS :]
    return bins if (bins != EMPTY).any() else binned(*shingle_hashes(last, np.array([len(last)])))


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Packed fingerprints of UTF-8 texts."""
    out = np.zeros((len(texts), BINS * BITS // 8), np.uint8)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= GROUP_BYTES):
            size += len(texts[j])
            j += 1
        if j == i + 1:
            out[i:j] = packed(_binned_in_pieces(texts[i]))
        else:
            edges = np.concatenate(([0], np.cumsum([len(t) for t in texts[i:j]]))).astype(np.int64)
            out[i:j] = packed(binned(*shingle_hashes(*word_hashes(np.frombuffer(b"".join(texts[i:j]), np.uint8), edges))))
        i = j
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated resemblance, 0 to 1, of packed fingerprints row by row, with the chance matches taken off."""
    differ = np.unpackbits(a ^ b, axis=1).reshape(len(a), BINS, BITS).any(axis=2)
    chance = 2.0**-BITS
    return np.clip((1 - differ.mean(axis=1) - chance) / (1 - chance), 0, 1)


def edited(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by as many first code points of the following one, or all of them."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order, each section's last followed by a copy, marked ``edge``, of the row after it."""
    last: tuple | None = None
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            ids, edge = part.column("doc_id").to_pylist(), part.column("edge").to_pylist()
            texts = pc.fill_null(part.column("text"), "").to_pylist()
            own = fingerprints([t.encode() for t in texts])
            if last:
                ids, edge, texts, own = [last[0], *ids], [last[1], *edge], [last[2], *texts], np.concatenate((last[3], own))
            keep = [k for k in range(len(ids) - 1) if not edge[k]]
            last = (ids[-1], edge[-1], texts[-1], own[-1:])
            if keep:
                changed = [edited(texts[k], texts[k + 1]).encode() for k in keep]
                marks = fingerprints(changed)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[k] for k in keep], pa.int64()),
                        pa.array([len(texts[k]) for k in keep], pa.int64()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
                        pa.array([own[k].tobytes().hex() for k in keep]),
                        pa.array([m.tobytes().hex() for m in marks]),
                        pa.array(likeness(own[keep], marks)),
                        pa.array(likeness(own[keep], own[[k + 1 for k in keep]])),
                    ],
                    names=RESULT.names,
                )


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", section_rows: int = 1000, most_sections: int = 100_000) -> DataFrame:
    """Each row's fingerprint, its edited text's, and the likeness of both and of the next row's.

    Ids, not texts, are cut into sections of about ``section_rows`` first, or of more rows if there would be over
    ``most_sections``: a hash picks PICKS ids a section, and every PICKS-th of them in order is a cut. The one shuffle of
    texts then sends each section, with a copy of the row that follows it, to a partition of its own, so the number of
    tasks follows the rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    keys = written(rows.select("doc_id", "hash"))
    one_in = max(1, max(section_rows, -(-keys.count() // most_sections)) // PICKS)
    picked = keys.where(F.pmod(F.xxhash64("doc_id", F.lit("cut")), F.lit(one_in)) == 0).select("doc_id").where("doc_id IS NOT NULL")
    cuts = np.sort(picked.distinct().toArrow().column(0).to_numpy().astype(np.int64))[PICKS - 1 :: PICKS]
    first = keys.withColumn("section", _section(cuts)(F.col("doc_id"), F.col("hash")))
    first = first.groupBy("section").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("id"), "hash")).alias("key"))
    heads = sorted(map(tuple, zip(*first.select("section", "key.id", "key.hash").toArrow().to_pydict().values(), strict=True)))
    placed = rows.withColumn("section", _section(cuts)(F.col("doc_id"), F.col("hash")))
    placed = placed.withColumn("before", _section_before(heads)(F.col("section"), F.col("doc_id"), F.col("hash")))
    own = F.struct(F.col("section"), F.lit(False).alias("edge"))
    copy = F.struct(F.col("before").alias("section"), F.lit(True).alias("edge"))
    placed = placed.select("doc_id", "text", "hash", F.inline(F.when(F.col("before") >= 0, F.array(own, copy)).otherwise(F.array(own))))
    dealt = placed.repartitionById(len(cuts) + 1, F.pmod("section", F.lit(len(cuts) + 1)).cast("int"))
    ordered = dealt.sortWithinPartitions("section", "edge", F.desc_nulls_last("doc_id"), "hash")
    return ordered.select("doc_id", "text", "edge").mapInArrow(_compared, RESULT)


def _section(cuts: np.ndarray):
    """Numbers rise as ids fall; rows without id are dealt by their hash, after all others."""

    @F.arrow_udf(T.LongType())
    def section(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        at = len(cuts) - np.searchsorted(cuts, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), "right")
        last = len(cuts) + 1 + 512 + (hashes.to_numpy(zero_copy_only=False) >> 54)
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), last, at))

    return section


def _section_before(heads: list[tuple]):
    """For the first row of a section the section before it, in a circle; -1 for other rows."""
    before = {(s, k, h): heads[i - 1][0] for i, (s, k, h) in enumerate(heads)}

    @F.arrow_udf(T.LongType())
    def section(sections: pa.Array, ids: pa.Array, hashes: pa.Array) -> pa.Array:
        keys = zip(sections.to_pylist(), ids.to_pylist(), hashes.to_pylist(), strict=True)
        return pa.array([before.get((s, None if i is None else ~i, h), -1) for s, i, h in keys], pa.int64())

    return section
