"""Joins, set operations and mutations over whole relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing_in(frame: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a partner."""
    return frame.join(side, on, "left_anti")


def kept_by(frame: DataFrame, keys: DataFrame, on: list[str], empty_keeps_all: bool) -> DataFrame:
    """Rows whose key is in ``keys``; an empty key set either keeps all rows (a guard) or none (a purge)."""
    kept = frame.join(keys.select(*on).distinct(), on, "left_semi")
    return frame if empty_keeps_all and keys.limit(1).count() == 0 else kept


def orphan_counts(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """side, n_swept: rows of either side without the other."""
    a = left.join(right, left[left_key] == right[right_key], "left_anti").agg(F.lit("left").alias("side"), F.count("*").alias("n_swept"))
    b = right.join(left, left[left_key] == right[right_key], "left_anti").agg(F.lit("right").alias("side"), F.count("*").alias("n_swept"))
    return a.unionByName(b)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and old ones whose key is not among them; columns that one side lacks are null."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def conditional_update(frame: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """frame with the updates' non-null values."""
    renamed = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = frame.join(renamed, keys, "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in frame.columns])


def reset(frame: DataFrame, columns: list[str]) -> DataFrame:
    """frame with columns set to null, of the same types."""
    kinds = dict(frame.dtypes)
    return frame.withColumns({c: F.lit(None).cast(kinds[c]) for c in columns})


def overwrite_scope(frame: DataFrame, path: str, scope: list[str]) -> None:
    """Replaces the partitions of the scopes that occur in frame; others stay."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)


def allocate_ids(existing: DataFrame, names: DataFrame, key: str, id_col: str) -> DataFrame:
    """key, id: known keys keep their id, new ones get the following numbers by key.

    New keys are numbered within ranges of the key, and the ranges' counts, one row each, give the offsets.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    fresh = names.select(key).where(F.col(key).isNotNull()).distinct().join(existing.select(key), key, "left_anti")
    start = existing.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    ordered = fresh.repartitionByRange(key).sortWithinPartitions(key)
    numbered = ordered.rdd.zipWithIndex().map(lambda pair: (pair[0][0], pair[1] + 1 + start))
    schema = StructType([fresh.schema[key], StructField(id_col, LongType())])
    return existing.select(key, F.col(id_col).cast("long").alias(id_col)).union(fresh.sparkSession.createDataFrame(numbered, schema))


def row_diff(desired: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """key, status: missing, unhashed or changed rows to compute again, and orphans to delete."""
    d, s = desired.select(key, F.col(digest).alias("want")), stored.select(key, F.col(digest).alias("have"), F.lit(True).alias("there"))
    both = d.withColumn("wanted", F.lit(True)).join(s, key, "full_outer")
    status = F.when(F.col("wanted").isNull(), "orphan").when(F.col("there").isNull(), "missing").when(F.col("have").isNull(), "unhashed").when(~F.col("have").eqNullSafe(F.col("want")), "changed")
    return both.select(key, status.alias("status")).where("status IS NOT NULL")


def run_join(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Both runs' members by id; a centrality that is not there is 0."""
    a = old.select(F.col(key).alias("a_id"), F.col("cluster_id").alias("from_cluster"), F.col("centrality").alias("a_c"))
    b = new.select(F.col(key).alias("b_id"), F.col("cluster_id").alias("to_cluster"), F.col("centrality").alias("b_c"))
    both = a.join(b, F.col("a_id") == F.col("b_id"), "full_outer")
    return both.select(F.coalesce("a_id", "b_id").alias("id"), "from_cluster", "to_cluster", F.coalesce("a_c", F.lit(0.0)).alias("from_centrality"), F.coalesce("b_c", F.lit(0.0)).alias("to_centrality"))


def digest_of(columns: list[Column]) -> Column:
    """SHA-256 over columns in order; nulls are marked, so they differ from empty texts."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns]), 256)


def table_digest(frame: DataFrame, keys: list[str], row_digest: str = "source_hash") -> DataFrame:
    """A digest of each group's row digests, whatever their order."""
    return frame.groupBy(*keys).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row_digest)), ","), 256).alias("source_hash"))


def retried(state: DataFrame, outcome: str, max_attempts: int) -> DataFrame:
    """status, attempts, error after an outcome (success, failure, terminal or null for none) of each row."""
    attempts = F.coalesce("attempts", F.lit(0))
    out = F.col(outcome)
    status = F.when(out == "success", "success").when(out == "terminal", "failed").when(out == "failure", F.when(attempts + 1 >= max_attempts, "failed").otherwise("pending")).otherwise(F.col("status"))
    tries = F.when(out.isin("success", "failure"), attempts + 1).otherwise(attempts)
    error = F.when(out == "success", F.lit(None).cast("string")).when(out.isNotNull(), F.concat(out, F.lit(" "), tries.cast("string"))).otherwise(F.col("error"))
    return state.select(*[c for c in state.columns if c not in ("status", "attempts", "error", outcome)], status.alias("status"), tries.cast("long").alias("attempts"), error.alias("error"))


def round_robin(candidates: DataFrame, group: str, member_order: list[Column], member: str, clip_order: list[Column], size: Column, per_member: int, total: int, budget: int) -> DataFrame:
    """candidates with pick_rank: first clips of all members, then second ones, up to the caps and the first that exceeds the budget."""
    by_member = Window.partitionBy(group, member).orderBy(*clip_order)
    rows = candidates.withColumn("_round", F.row_number().over(by_member)).where(F.col("_round") <= per_member)
    order = Window.partitionBy(group).orderBy("_round", *member_order)
    rows = rows.withColumn("pick_rank", F.row_number().over(order).cast("long")).withColumn("_used", F.sum(size).over(order))
    over = F.sum(F.when(F.col("_used") > budget, 1).otherwise(0)).over(order)
    return rows.withColumn("_over", over).where((F.col("_over") == 0) & (F.col("pick_rank") <= total)).drop("_round", "_used", "_over")
