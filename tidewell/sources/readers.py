"""Seeds, nested profiles, files, fetched media, paged services."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MEDIA = """array<struct<id:bigint,code:string,video_url:string,play_count:bigint,like_count:bigint,
taken_at:bigint,video_duration:double,caption:struct<text:string>>>"""

#: Smallest files that count as fetched.
LEAST_BYTES = {"image": 256, "video": 1024}


def username(url: Column) -> Column:
    """The first part of a url's path; a bare name is its own path."""
    path = F.coalesce(F.try_parse_url(F.trim(url), F.lit("PATH")), F.trim(url))
    return F.split(F.regexp_replace(path, "^/+", ""), "/")[0]


def seeds(rows: DataFrame, column: str, existing: DataFrame | None = None) -> DataFrame:
    """username, n: distinct non-empty names with their number of rows, without those that exist."""
    names = rows.select(username(F.col(column)).alias("username")).where("username <> ''").groupBy("username").agg(F.count("*").alias("n"))
    return names if existing is None else names.join(existing.select("username"), "username", "left_anti")


def seed_file(spark: SparkSession, path: str) -> DataFrame:
    """First column of a CSV file without header."""
    return spark.read.csv(path, header=False).select(F.col("_c0").alias("url"))


def flattened(profiles: DataFrame, media: str, existing: DataFrame) -> DataFrame:
    """A row for each medium of a profile's JSON that is not stored yet, the most played first."""
    rows = profiles.select("user_id", F.inline(F.from_json(media, MEDIA)))
    rows = rows.select(F.col("id").alias("clip_id"), "user_id", "video_url", "play_count", "like_count", "taken_at", "video_duration", F.col("caption.text").alias("caption_text"))
    return rows.dropDuplicates(["clip_id"]).join(existing.select("clip_id"), "clip_id", "left_anti").orderBy(F.desc(F.coalesce("play_count", F.lit(0))), "clip_id")


def label_file(spark: SparkSession, path: str) -> DataFrame:
    """label, pos of a JSON array of names."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "label"))


def phrases(lines: DataFrame, column: str = "value", least: int = 5) -> DataFrame:
    """Distinct trimmed lines that are neither blank, comments nor too short."""
    one = F.trim(F.col(column))
    return lines.select(one.alias("phrase")).where((F.length("phrase") >= least) & ~F.startswith("phrase", F.lit("#"))).distinct()


def media_stats(spark: SparkSession, folder: str) -> DataFrame:
    """media_id, size, mtime of <folder>/<id>.<extension>; contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    return files.select(F.regexp_extract("path", "([0-9]+)\\.[^./]+$", 1).try_cast("long").alias("media_id"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def with_media(clips: DataFrame, files: DataFrame) -> DataFrame:
    """clips with size and mtime; -1 where there is no file."""
    found = files.select(F.col("media_id").alias("clip_id"), "size", F.unix_micros("mtime").alias("mtime"))
    return clips.join(found, "clip_id", "left").withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("size", "mtime")})


def download_jobs(clips: DataFrame, retry_failed: bool = False) -> DataFrame:
    """clip_id, kind, url, least_bytes: clips not downloaded yet; failed ones only when asked; none without a url."""
    open_clips = clips.where(F.col("is_downloaded").isNull() | (F.lit(retry_failed) & ~F.col("is_downloaded")))
    job = lambda kind, url: F.when(F.col(url).isNotNull() & ~F.coalesce(F.col(f"has_{kind}"), F.lit(False)), F.struct(F.lit(kind).alias("kind"), F.col(url).alias("url"), F.lit(LEAST_BYTES[kind]).alias("least_bytes")))
    jobs = F.array_compact(F.array(job("image", "thumbnail_url"), job("video", "video_url")))
    return open_clips.select("clip_id", F.inline(jobs))


def fetched(jobs: DataFrame, fetch: Callable[[str], bytes], attempts: int = 3) -> DataFrame:
    """clip_id, kind, size, error; fetch runs on executors and is retried, and short bodies are errors."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = []
            for r in frame.itertuples():
                size, error = None, "not tried"
                for _ in range(attempts):
                    try:
                        size, error = len(fetch(r.url)), None
                        if size < r.least_bytes:
                            size, error = None, "too small"
                        break
                    except Exception as problem:
                        error = str(problem)[:300]
                out.append((r.clip_id, r.kind, size, error))
            yield pd.DataFrame(out, columns=["clip_id", "kind", "size", "error"])

    return jobs.mapInPandas(run, "clip_id long, kind string, size long, error string")


class Pages(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class PagedReader(DataSourceReader):
    """Reads up to ``max_pages`` pages of each name from ``client`` ("module:function", called with name and cursor)."""

    def __init__(self, options: dict):
        self.names = [n for n in options.get("names", "").split(",") if n]
        self.client, self.most = options["client"], int(options.get("max_pages", "5"))

    def partitions(self) -> list[Pages]:
        return [Pages(n) for n in self.names]

    def read(self, partition: Pages) -> Iterator[tuple]:
        import importlib

        module, _, name = self.client.partition(":")
        call, cursor = getattr(importlib.import_module(module), name), None
        for page in range(self.most):
            body, cursor = call(partition.name, cursor)
            yield partition.name, page, body
            if cursor is None:
                return


class PagedProfiles(DataSource):
    """spark.read.format("paged_profiles"): username, page, body."""

    @classmethod
    def name(cls) -> str:
        return "paged_profiles"

    def schema(self) -> str:
        return "username string, page int, body string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)
