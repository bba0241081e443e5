"""Dense vectors: pooling, centring, codecs, exact silhouette."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.ranking import numbered


def long_form(frame: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, pos, value: a row for each component."""
    return frame.select(*keys, F.posexplode(vector).alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


def mean_pool(frame: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, pos, value: component means; partial sums are combined before the shuffle."""
    return long_form(frame, keys, vector).groupBy(*keys, "pos").agg(F.avg("value").alias("value"))


def pooled_arrays(frame: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, embedding: the means as arrays."""
    rows = mean_pool(frame, keys, vector).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_v"))
    return rows.select(*keys, F.transform("_v", lambda x: x["value"].cast("float")).alias("embedding"))


def centred(frame: DataFrame, key: str, vector: str, scale: bool = False) -> DataFrame:
    """key, pos, value: less the column mean, and over the population deviation (1 where that is 0) if asked.

    Column statistics are one row a component, so the join back is small on one side.
    """
    rows = long_form(frame, [key], vector)
    stats = rows.groupBy("pos").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    value = F.col("value") - F.col("_m")
    if scale:
        value = value / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    return rows.join(stats, "pos").select(key, "pos", value.alias("value"))


def encode_vector(vector: Column) -> Column:
    """float32 little-endian bytes."""

    @F.arrow_udf("binary")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        for column in batches:
            yield pa.array([None if v is None else np.asarray(v, "<f4").tobytes() for v in column.to_pylist()], pa.binary())

    return encoded(vector)


def decode_vector(data: Column) -> Column:
    """Bytes to array<float>."""

    @F.arrow_udf("array<float>")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        for column in batches:
            yield pa.array([None if v is None else np.frombuffer(v, "<f4").tolist() for v in column.to_pylist()], pa.list_(pa.float32()))

    return decoded(data)


def patch_pool(patches: Column) -> Column:
    """Mean over patches of (first token, second token, mean of the rest), end to end; patches: array<array<array<double>>>."""

    @F.arrow_udf("array<double>")
    def pooled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        for column in batches:
            out = []
            for clip in column.to_pylist():
                parts = [np.concatenate([p[0], p[1], np.mean(p[2:], axis=0)]) for p in map(np.asarray, clip or [])]
                out.append(np.mean(parts, axis=0).tolist() if parts else None)
            yield pa.array(out, pa.list_(pa.float64()))

    return pooled(patches)


#: Rows that a task takes of each side at most, on average, and distances that it holds at once.
BLOCK_ROWS, HELD = 8192, 1 << 21


def sums_by_label(x, y, kx, ky, ly):
    """(labels of y, their sizes, distances from each x to each label's y, summed); equal keys are at distance 0."""
    import numpy as np

    order = np.argsort(ly, kind="stable")
    y, ky = y[order], ky[order]
    names, starts, sizes = np.unique(ly[order], return_index=True, return_counts=True)
    totals, squares = np.empty((len(x), len(names))), (y**2).sum(1)
    step = max(1, HELD // max(1, len(y)))
    for i in range(0, len(x), step):
        part = x[i : i + step]
        d = part @ y.T
        d *= -2
        d += (part**2).sum(1)[:, None]
        d += squares
        np.sqrt(np.maximum(d, 0, out=d), out=d)
        d[kx[i : i + step, None] == ky] = 0
        totals[i : i + step] = np.add.reduceat(d, starts, axis=1)
    return names, sizes, totals


def silhouette(frame: DataFrame, key: str, vector: str, label: str, blocks: int = 8) -> DataFrame:
    """key, label, s: the exact Euclidean silhouette of each row.

    Rows meet block by block: each task compares one block of queries with one block of points and returns sums by
    label, so no task holds more than two blocks of about BLOCK_ROWS rows, and sums are combined afterwards. There are
    ``blocks`` at least.
    """
    import numpy as np
    import pandas as pd

    blocks = max(blocks, -(-frame.count() // BLOCK_ROWS))
    rows = frame.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.col(label).cast("long").alias("l")).withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    every = F.array(*[F.lit(i) for i in range(blocks)])
    left = rows.select("*", F.explode(every).alias("o")).withColumnRenamed("b", "q")
    right = rows.select("k", "v", "l", F.col("b").alias("o"), F.explode(every).alias("q"))

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"k": [], "own": [], "l": [], "total": [], "n": []})
        x, y = np.stack(a["v"]).astype(float), np.stack(b["v"]).astype(float)
        names, sizes, totals = sums_by_label(x, y, a["k"].to_numpy(), b["k"].to_numpy(), b["l"].to_numpy())
        each = len(names)
        return pd.DataFrame({"k": np.repeat(a["k"].to_numpy(), each), "own": np.repeat(a["l"].to_numpy(), each), "l": np.tile(names, len(a)), "total": totals.ravel(), "n": np.tile(sizes, len(a))})

    found = left.groupBy("q", "o").cogroup(right.groupBy("q", "o")).applyInPandas(lambda a, b: sums(a, b), "k long, own long, l long, total double, n long")
    means = found.groupBy("k", "own", "l").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mine = F.max(F.when(F.col("own") == F.col("l"), F.when(F.col("n") > 1, F.col("total") / (F.col("n") - 1))))
    other = F.min(F.when(F.col("own") != F.col("l"), F.col("total") / F.col("n")))
    out = means.groupBy("k", "own").agg(mine.alias("a"), other.alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    return out.select(F.col("k").alias(key), F.col("own").alias(label), F.coalesce(s, F.lit(0.0)).alias("s"))


def member_distances(frame: DataFrame, label: str, x: str, y: str) -> DataFrame:
    """frame with distance from the label's centroid."""
    centre = frame.groupBy(label).agg(F.avg(x).alias("_cx"), F.avg(y).alias("_cy"))
    return frame.join(centre, label).withColumn("distance", F.hypot(F.col(x) - F.col("_cx"), F.col(y) - F.col("_cy"))).drop("_cx", "_cy")


def centroid_percentile(frame: DataFrame, label: str, distance: str = "distance") -> DataFrame:
    """frame with percentile: the share of the label's members that are nearer, in percent."""
    sizes = frame.groupBy(label).agg(F.count("*").alias("_members"))
    ranked = numbered(frame, [label], distance, None, "_rank").join(sizes, label)
    percent = F.when(F.col("_members") <= 1, 0.0).otherwise(F.lit(100.0) * (F.col("_rank") - 1) / F.nullif(F.col("_members") - 1, F.lit(0)))
    return ranked.withColumn("percentile", percent).drop("_rank", "_members")
