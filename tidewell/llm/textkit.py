"""Array views of Arrow text columns, and the shared folder for cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the contracts call a word: a maximal run outside space and \t\n\v\f\r.
WORD_SEPARATORS = "[\\x20\\x09-\\x0D]+"

#: Bytes of text that the array code looks at together; one longer document is taken alone.
GROUP_BYTES = 1 << 21


def utf8_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    kind = pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) that hold about ``limit`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def pieces(text: bytes, limit: int = GROUP_BYTES) -> Iterator[bytes]:
    """text in parts of about ``limit`` bytes, cut before spaces that follow a visible ASCII character."""
    start = 0
    while len(text) - start > 2 * limit:
        at = text.find(b" ", start + limit)
        while at > 0 and not 0x21 <= text[at - 1] <= 0x7E:
            at = text.find(b" ", at + 1)
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of bytes; data is cut at offsets."""
    kind, width = (pa.binary(), np.int32) if offsets[-1] < 2**31 else (pa.large_binary(), np.int64)
    buffers = [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(np.ascontiguousarray(data))]
    found = pa.Array.from_buffers(kind, len(offsets) - 1, buffers)
    return found if width is np.int32 else found.cast(pa.binary())


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Only a session within one JVM may lack that setting: it gets the temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = os.path.join(tempfile.gettempdir(), "tidewell-checkpoints")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/tidewell-{uuid.uuid4().hex}"


def written(frame: DataFrame) -> DataFrame:
    """The same rows, read again from a table in the shared folder: later plans start from files that outlive executors."""
    spark = frame.sparkSession
    folder = shared_folder(spark)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def carried(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (all columns of docs), doc_id, text and hash (of the text, null as empty): no column's name can clash."""
    text = F.col(text_col)
    return docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"))


def chosen(docs: DataFrame, id_col: str, text_col: str, keys: DataFrame) -> DataFrame:
    """carried() with the columns of ``keys`` (of, of_hash, rows, ...), for rows whose id and hash are among them; equal rows once."""
    found = carried(docs, id_col, text_col).join(keys, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash")))
    if not keys.where("rows > 1").limit(1).count():
        return found
    return found.where("rows = 1").union(found.where("rows > 1").dropDuplicates(["of", "of_hash"]))
