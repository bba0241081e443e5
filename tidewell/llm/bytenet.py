"""Quality classifier (operator 2): a byte-level convolutional network in numpy.

Filters of WIDTH bytes slide byte by byte over the UTF-8 text. Each filter's maximum is taken over chunks of
two blocks that overlap by one block and cover the whole document; the rectified maxima are averaged over the chunks
and one logistic unit turns them into a probability. The document is padded with zero bytes to whole blocks, so its
end is covered too; a window never reaches into another document.

The network is trained on the driver with the whole texts of a bounded sample: SAMPLE_ROWS labelled documents, those
with the smallest hashes of their ids. Scoring reads every byte of every document.

Null texts count as empty; an empty text is one chunk of padding. Repeated labels of a document count by their
smaller value, null labels not at all. With labels of one kind, or none, every score is the share of label 1
(one half without labels). Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.rules import sampled
from tidewell.llm.textkit import groups, utf8_views

WIDTH, FILTERS, DIMENSIONS = 6, 24, 8
BLOCK = 128
CHUNK = 2 * BLOCK
THRESHOLD = 0.3

SAMPLE_ROWS = 2000
EPOCHS = 12

#: Blocks that are looked at together, so that a long document needs little more memory than its text.
SLICE = 2048

#: Windows of a document's last block that would reach past its end.
OUTSIDE = WIDTH - 1


@dataclass
class Net:
    """Byte vectors, filters, and the logistic unit; ``prior`` answers if there was nothing to learn from."""

    vectors: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    prior: float | None = None

    def tables(self) -> list[np.ndarray]:
        """For each two bytes of a window, what they add to the filters."""
        return pair_tables(self.vectors, self.filters)


def pair_tables(vectors: np.ndarray, filters: np.ndarray) -> list[np.ndarray]:
    taps = [(vectors @ filters[k]).astype(np.float32) for k in range(WIDTH)]
    return [(taps[k][:, None, :] + taps[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, WIDTH, 2)]


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buffer, first block of each text and the number of blocks) with WIDTH zero bytes at least after each text."""
    sizes = np.diff(offsets)
    blocks = -(-(sizes + WIDTH) // BLOCK)
    first = np.concatenate(([0], np.cumsum(blocks)))
    buffer = np.zeros(first[-1] * BLOCK + WIDTH, np.uint8)
    shift = np.repeat(first[:-1] * BLOCK - (offsets[:-1] - offsets[0]), sizes)
    buffer[np.arange(offsets[-1] - offsets[0]) + shift] = data[offsets[0] : offsets[-1]]
    return buffer, first


def block_maxima(tables: list[np.ndarray], buffer: np.ndarray, first: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each filter's maximum over the windows that begin in each block and, if asked for, where it is in the buffer."""
    pairs = buffer[:-1].astype(np.int32) * 256 + buffer[1:]
    last = first[1:] - 1
    best = np.empty((first[-1], tables[0].shape[1]), np.float32)
    where = np.empty(best.shape, np.int64) if places else None
    for a in range(0, first[-1], SLICE):
        b = min(a + SLICE, first[-1])
        out = tables[0][pairs[a * BLOCK : b * BLOCK]]
        for k, one in enumerate(tables[1:], 1):
            out += one[pairs[a * BLOCK + 2 * k : b * BLOCK + 2 * k]]
        out = out.reshape(-1, BLOCK, out.shape[1])
        out[last[(last >= a) & (last < b)] - a, BLOCK - OUTSIDE :] = -np.inf
        if places:
            at = out.argmax(axis=1)
            best[a:b] = np.take_along_axis(out, at[:, None, :], 1)[:, 0]
            where[a:b] = at + BLOCK * np.arange(a, b)[:, None]
        else:
            best[a:b] = out.max(axis=1)
    return best, where


def chunk_maxima(best: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima of the chunk that starts at each block, and whether they come from its second block.

    A text's last block is a chunk only if it is the one block of its text; elsewhere it belongs to the chunk before.
    """
    second = np.zeros(best.shape, bool)
    second[:-1] = best[1:] > best[:-1]
    second[first[1:] - 1] = False
    chunk = best.copy()
    chunk[:-1] = np.where(second[:-1], best[1:], best[:-1])
    return chunk, second


def means(active: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean over each text's chunks, what one chunk's value counts for in it)."""
    blocks = np.diff(first)
    share = np.repeat(1.0 / np.maximum(blocks - 1, 1), blocks)
    # a text of several blocks has one chunk fewer than blocks; its last block is in the chunk before
    share[first[1:] - 1] = blocks == 1
    return np.add.reduceat(active * share[:, None], first[:-1], axis=0), share


def scores(net: Net, tables: list[np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probabilities of the texts that offsets cut data into."""
    buffer, first = padded(data, offsets)
    active = np.maximum(chunk_maxima(block_maxima(tables, buffer, first)[0], first)[0] + net.bias, 0)
    return 1 / (1 + np.exp(-np.clip(means(active, first)[0] @ net.weights + net.offset, -30, 30)))


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, rate: float = 0.02, seed: int = 0) -> Net:
    """Whole texts and their labels. Adam on the log loss, in an order that the seed fixes."""
    random = np.random.default_rng(seed)
    shape = (WIDTH, DIMENSIONS, FILTERS)
    values = {
        "vectors": random.normal(0, 0.5, (256, DIMENSIONS)),
        "filters": random.normal(0, 0.5 / np.sqrt(WIDTH * DIMENSIONS / 4), shape),
        "bias": np.zeros(FILTERS),
        "weights": random.normal(0, 0.3, FILTERS),
        "offset": np.zeros(1),
    }
    target = np.array(labels, float)
    share = target.mean() if len(target) else 0.5
    if not len(target) or not 0 < share < 1:
        return Net(*[np.asarray(v) for v in list(values.values())[:4]], 0.0, float(share))
    values["offset"][0] = np.log(share / (1 - share))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in values.items()}
    step = 0
    for epoch in range(epochs):
        order = random.permutation(len(texts))
        for batch in np.array_split(order, max(1, len(order) // 64)):
            offsets = np.concatenate(([0], np.cumsum([len(texts[i]) for i in batch])))
            buffer, first = padded(np.frombuffer(b"".join(texts[i] for i in batch), np.uint8), offsets)
            blocks, where = block_maxima(pair_tables(values["vectors"], values["filters"]), buffer, first, places=True)
            chunk, second = chunk_maxima(blocks, first)
            where[:-1] = np.where(second[:-1], where[1:], where[:-1])
            best = chunk + values["bias"]
            pooled, counted = means(np.maximum(best, 0), first)
            p = 1 / (1 + np.exp(-np.clip(pooled @ values["weights"] + values["offset"][0], -30, 30)))
            wrong = (p - target[batch]) / len(batch)
            back = (np.repeat(wrong, np.diff(first)) * counted)[:, None] * values["weights"] * (best > 0)
            grown = {"weights": pooled.T @ wrong, "offset": np.array([wrong.sum()]), "bias": back.sum(0)}
            vectors, filters = np.zeros((256, DIMENSIONS)), np.zeros(shape)
            for k in range(WIDTH):
                seen = np.arange(FILTERS) * 256 + buffer[where + k]
                onehot = np.bincount(seen.ravel(), back.ravel(), FILTERS * 256).reshape(FILTERS, 256)
                filters[k] = (onehot @ values["vectors"]).T
                vectors += onehot.T @ values["filters"][k].T
            grown |= {"vectors": vectors, "filters": filters}
            step += 1
            for name, slope in grown.items():
                slope = slope + 1e-4 * values[name] * (name in ("filters", "weights"))
                m, v = moment[name]
                m += 0.1 * (slope - m)
                v += 0.001 * (slope * slope - v)
                values[name] -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Net(values["vectors"], values["filters"], values["bias"].astype(np.float32), values["weights"], float(values["offset"][0]))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Net:
    """docs: doc_id, text; labels: doc_id, quality (0 or 1)."""
    sample = sampled(docs, labels, sample_rows).select("doc_id", "quality", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = sorted(map(tuple, sample.collect()))
    return train([bytes(r[2]) for r in rows], [r[1] for r in rows])


def score(net: Net, text: Column) -> Column:
    """Probability of label 1; every byte of the text is read."""
    held: list[list[np.ndarray]] = []

    @F.arrow_udf(T.DoubleType())
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not held:
            held.append(net.tables())
        for column in batches:
            if net.prior is not None:
                yield pa.array(np.full(len(column), net.prior))
                continue
            data, offsets = utf8_views(column)
            yield pa.array(np.concatenate([np.zeros(0), *[scores(net, held[0], data, offsets[i : j + 1]) for i, j in groups(offsets, 1 << 19)]]))

    return probability(text)
