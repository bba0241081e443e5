"""Seals of stages: which digests a result was made from, and what must be made again."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = ("data_hash", "config_hash", "dependency_hash")
LEDGER = T.StructType([T.StructField(n, T.StringType()) for n in ("stage_name", "scope_key", *PARTS)] + [T.StructField("version", T.LongType())])

#: Which stages a stage reads from.
DEPENDENCIES = {
    "filter": ("profiles",),
    "download": ("filter",),
    "audio": ("download",),
    "speech": ("audio",),
    "captions": ("filter",),
    "embeddings": ("audio", "speech", "captions"),
    "user_embeddings": ("embeddings",),
    "clustering": ("user_embeddings",),
    "labels": ("clustering",),
    "visualization": ("clustering", "labels"),
}


def digest(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()


def settings_digest(settings: dict, names: list[str]) -> str:
    """Of the named settings only, as sorted JSON."""
    return digest(json.dumps({n: settings[n] for n in names if n in settings}, sort_keys=True, default=str))


def topological(edges: dict[str, tuple[str, ...]]) -> list[str]:
    """Names with what they depend on first; unknown names and cycles are errors."""
    out: list[str] = []
    open_names: set[str] = set()

    def visit(name: str) -> None:
        if name in out:
            return
        if name in open_names:
            raise ValueError(f"cycle at {name}")
        open_names.add(name)
        for one in edges.get(name, ()):
            visit(one)
        open_names.discard(name)
        out.append(name)

    for name in edges:
        visit(name)
    return out


@dataclass(frozen=True)
class Fingerprint:
    data_hash: str
    config_hash: str
    dependency_hash: str


def differences(current: DataFrame, sealed: DataFrame) -> DataFrame:
    """stage_name, scope_key, diff of stages that are stale: the names that differ, joined by +, or "no prior state"."""
    keys = ["stage_name", "scope_key"]
    old = sealed.select(*keys, *[F.col(p).alias(f"_{p}") for p in PARTS], F.lit(True).alias("_there"))
    joined = current.join(old, keys, "left")
    parts = F.concat_ws("+", *[F.when(~F.col(p).eqNullSafe(F.col(f"_{p}")), F.lit(p.removesuffix("_hash"))) for p in PARTS])
    diff = F.when(F.col("_there").isNull(), "no prior state").otherwise(parts)
    return joined.select(*keys, diff.alias("diff")).where("diff <> ''")


class Ledger:
    """A small Parquet table of seals; each seal is a new row, and the highest version counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def rows(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], LEDGER)
        rows = self.spark.read.schema(LEDGER).parquet(self.folder)
        last = rows.groupBy("stage_name", "scope_key").agg(F.max(F.struct("version", *PARTS)).alias("s"))
        return last.select("stage_name", "scope_key", *[F.col(f"s.{p}").alias(p) for p in PARTS], "s.version")

    def seal(self, stage: str, scope: str, mark: Fingerprint) -> None:
        version = (self.rows().agg(F.max("version")).first()[0] or 0) + 1
        row = (stage, scope, mark.data_hash, mark.config_hash, mark.dependency_hash, version)
        self.spark.createDataFrame([row], LEDGER).write.mode("append").parquet(self.folder)

    def diff(self, stage: str, scope: str, mark: Fingerprint) -> str:
        """Empty if the stage is fresh."""
        now = self.spark.createDataFrame([(stage, scope, mark.data_hash, mark.config_hash, mark.dependency_hash, 0)], LEDGER)
        found = differences(now, self.rows()).first()
        return found["diff"] if found else ""

    def must_reset(self, stage: str, scope: str, mark: Fingerprint, on: tuple[str, ...] = ("config",)) -> bool:
        """Whether old results must go first: never on a first run, on a changed configuration always, else as asked."""
        diff = self.diff(stage, scope, mark)
        return diff not in ("", "no prior state") and bool({"config", *on} & set(diff.split("+")))

    def dependency_digest(self, stage: str, scope: str) -> str:
        """Of the seal of an upstream stage; of nothing if there is none."""
        row = self.rows().where((F.col("stage_name") == stage) & (F.col("scope_key") == scope)).first()
        return digest("".join(row[p] or "" for p in PARTS) if row else "")


def incremental(desired: DataFrame, stored: DataFrame, key: str, compute, empty_guard: bool = True) -> tuple[DataFrame, DataFrame]:
    """(new stored rows, failed rows): recomputes missing and changed rows only, drops orphans unless nothing is desired.

    desired: key, source_hash and inputs. compute: DataFrame to key, value, error. The caller seals when failed is empty.
    """
    from tidewell.operators.relational import kept_by, row_diff

    todo = row_diff(desired, stored, key, "source_hash").where("status <> 'orphan'").select(key)
    made = compute(desired.join(todo, key, "left_semi")).join(desired.select(key, "source_hash"), key)
    good = made.where("error IS NULL").drop("error").select(stored.columns)
    kept = kept_by(stored, desired.select(key), [key], empty_guard).join(good.select(key), key, "left_anti")
    return kept.unionByName(good), made.where("error IS NOT NULL").select(key, "error")
