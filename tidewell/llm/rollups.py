"""Token counts (operator 8) as delta-maintained rollups.

Changes to documents become signed contributions: an insert adds a document and its tokens to the totals of its
source, language and tokenizer version, a delete takes them off, and a revised count takes the old off and adds
the new. A batch of changes is summed before it is stored, so totals are sums of a few rows a batch, never of
documents. A batch commits by a marker that names its folder. The marker is written aside and renamed without
overwriting, so it is complete when it appears and appears once only: a batch that is committed again, or by two
writers, counts once, and a crash at any point leaves either a committed batch or one that can be committed again.
(HDFS renames so in one step; a local file system checks first and then renames, which suits one writer.)

compact() sums all committed batches into one base. A base lists the batches it covers; their own markers and data
no longer count, and are deleted. Bases are numbered and published like markers, so of two compactions one gives way.

A null source, language or version is a group of its own, a null count adds no tokens, and each row of a batch
counts, repeated rows too. Groups whose documents have all gone are left out of the totals. An empty batch commits and
changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("source", "lang", "tokenizer_version")
STATE = (*KEYS, "n_tokens")
DELTA = T.StructType([*[T.StructField(k, T.StringType()) for k in KEYS], T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())])


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, STATE and times: how often each state is added, or, if negative, taken off, from old to new.

    A state only in new is an insert, only in old a delete; a document in both with another state has one row of each,
    its revision. Rows that repeat on one side count as often as they do.
    """
    side = lambda frame, sign: frame.select("doc_id", *STATE, F.lit(sign).alias("times"))
    rows = side(old, -1).unionAll(side(new, 1))
    return rows.groupBy("doc_id", *STATE).agg(F.sum("times").alias("times")).where("times <> 0")


def inserts(new: DataFrame) -> DataFrame:
    """Every row of new as an insert."""
    return new.select("doc_id", *STATE, F.lit(1).cast("long").alias("times"))


def signed(batch: DataFrame) -> DataFrame:
    """The batch's sums by KEYS: n_docs and n_tokens may be negative."""
    return _summed(batch.select(*KEYS, F.col("times").alias("n_docs"), (F.col("times") * F.coalesce("n_tokens", F.lit(0))).alias("n_tokens")))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))


class Rollup:
    """Totals in a folder of any file system that Spark reaches: data/<batch>-<attempt>, commits/<batch> and bases/<number>."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = hadoop.Path
        self.files = self.path(self.folder).getFileSystem(conf)
        self.context = hadoop.FileContext.getFileContext(self.path(self.folder).makeQualified(self.files.getUri(), self.files.getWorkingDirectory()).toUri(), conf)
        self.keep_target = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)

    def _listed(self, kind: str) -> dict:
        top = self.path(f"{self.folder}/{kind}")
        return {s.getPath().getName(): s.getPath() for s in self.files.listStatus(top)} if self.files.exists(top) else {}

    def _read(self, path) -> str:
        stream = self.files.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _publish(self, name: str, content: str) -> bool:
        """A complete file of that name; False, and nothing changes, if there is one."""
        target, aside = self.path(f"{self.folder}/{name}"), self.path(f"{self.folder}/aside/{uuid.uuid4().hex}")
        stream = self.files.create(aside, False)
        stream.write(bytearray(content.encode()))
        stream.close()
        self.files.mkdirs(target.getParent())
        try:
            self.context.rename(aside, target, self.keep_target)
        except Exception:
            self.files.delete(aside, False)
            if not self.files.exists(target):
                raise
            return False
        return True

    def _base(self) -> tuple[int, str | None, set[str]]:
        """Number, data folder and covered batches of the last base; 0 if there is none."""
        bases = self._listed("bases")
        if not bases:
            return 0, None, set()
        last = max(bases, key=int)
        content = json.loads(self._read(bases[last]))
        return int(last), content["data"], set(content["covers"])

    def _open(self, covered: set[str]) -> dict[str, str]:
        """Data folder of each committed batch that no base covers."""
        return {name: self._read(path) for name, path in self._listed("commits").items() if name not in covered}

    def committed(self) -> set[str]:
        """All batches that count."""
        covered = self._base()[2]
        return covered | (self._listed("commits").keys() - covered)

    def _delta(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], DELTA)
        return _summed(self.spark.read.schema(DELTA).parquet(*[f"{self.folder}/data/{name}" for name in names]))

    def commit(self, batch_id: str, batch: DataFrame) -> bool:
        """Adds a batch of changes; False, and nothing changes, if a batch of that id is committed already."""
        if batch_id in self.committed():
            return False
        name = f"{batch_id}-{uuid.uuid4().hex}"
        signed(batch).write.parquet(f"{self.folder}/data/{name}")
        if self._publish(f"commits/{batch_id}", name):
            return True
        self.files.delete(self.path(f"{self.folder}/data/{name}"), True)
        return False

    def compact(self) -> bool:
        """One base for all committed batches; False if another compaction came first or there is nothing to sum."""
        number, data, covered = self._base()
        found = self._open(covered)
        if not found:
            return False
        name = f"base-{uuid.uuid4().hex}"
        self._delta([*([data] if data else []), *sorted(found.values())]).write.parquet(f"{self.folder}/data/{name}")
        if not self._publish(f"bases/{number + 1}", json.dumps({"data": name, "covers": sorted(covered | found.keys())})):
            self.files.delete(self.path(f"{self.folder}/data/{name}"), True)
            return False
        for batch_id, old in found.items():
            self.files.delete(self.path(f"{self.folder}/commits/{batch_id}"), False)
            self.files.delete(self.path(f"{self.folder}/data/{old}"), True)
        if data:
            self.files.delete(self.path(f"{self.folder}/data/{data}"), True)
        return True

    def totals(self) -> DataFrame:
        """KEYS, n_docs and n_tokens of the groups that have documents."""
        _, data, covered = self._base()
        names = [*([data] if data else []), *sorted(self._open(covered).values())]
        return self._delta(names).where("n_docs <> 0 OR n_tokens <> 0")
