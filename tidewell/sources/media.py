"""Audio files as columns: probes, decoding, freshness, orphans. Decoders other than WAV plug in as functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.predicates import fresh

#: What analysis reads: rate, channels, bytes of a sample.
FORMAT = (16_000, 1, 2)


def wav_format(content: bytes | None) -> tuple[int, int, int, float] | None:
    """(rate, channels, sample bytes, seconds), or None if it is no WAV file."""
    import io
    import wave

    try:
        with wave.open(io.BytesIO(content or b"")) as sound:
            return sound.getframerate(), sound.getnchannels(), sound.getsampwidth(), sound.getnframes() / sound.getframerate()
    except (wave.Error, EOFError, ZeroDivisionError):
        return None


def probed(files: DataFrame, probe: Callable[[bytes], tuple | None] = wav_format) -> DataFrame:
    """path, rate, channels, sample_bytes, seconds; nulls where the probe could not tell."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            found = [probe(c) or (None,) * 4 for c in frame["content"]]
            yield pd.DataFrame([(p, *f) for p, f in zip(frame["path"], found, strict=True)], columns=["path", "rate", "channels", "sample_bytes", "seconds"]).astype({"rate": "Int64", "channels": "Int64", "sample_bytes": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, rate long, channels long, sample_bytes long, seconds double")


def decoded(files: DataFrame) -> DataFrame:
    """path, samples (-1 to 1) of mono 16-bit WAV files; null for others."""

    def run(frames: Iterator) -> Iterator:
        import io
        import wave

        import numpy as np
        import pandas as pd

        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                kind = wav_format(content)
                if kind is None or kind[1:3] != FORMAT[1:]:
                    out.append((path, None))
                    continue
                with wave.open(io.BytesIO(content)) as sound:
                    out.append((path, (np.frombuffer(sound.readframes(sound.getnframes()), "<i2") / 32768).astype(np.float32).tolist()))
            yield pd.DataFrame(out, columns=["path", "samples"])

    return files.select("path", "content").mapInPandas(run, "path string, samples array<float>")


def format_drifted() -> Column:
    """Over probed(): a known format that is not the one analysis reads; unknown ones have not drifted."""
    rate, channels, width = FORMAT
    return F.coalesce((F.col("rate") != rate) | (F.col("channels") != channels) | (F.col("sample_bytes") != width), F.lit(False))


def to_transcode(videos: DataFrame, audio: DataFrame) -> DataFrame:
    """media_id of videos whose audio is missing or older; both frames are media_stats()."""
    out = audio.select("media_id", F.col("mtime").alias("out_mtime"))
    return videos.join(out, "media_id", "left").where(~fresh(F.col("out_mtime"), F.col("mtime"))).select("media_id")


def audio_to_sweep(files: DataFrame, selected: DataFrame) -> DataFrame:
    """path of audio whose clip is not selected, or whose format drifted; files: media_id, path and probed() columns."""
    known = selected.select(F.col("clip_id").alias("media_id"), F.lit(True).alias("wanted")).distinct()
    return files.join(known, "media_id", "left").where(F.col("wanted").isNull() | format_drifted()).select("path")


def delete_files(paths: DataFrame) -> int:
    """Deletes a sweep's files, one at a time as they arrive at the driver; the number deleted."""
    spark, gone = paths.sparkSession, 0
    for row in paths.toLocalIterator():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(row["path"])
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False))
    return gone
