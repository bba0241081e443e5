"""Cluster and account profiles: blocks that join on (case, cluster) or account."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.geometry import compactness, ellipse
from tidewell.operators import clusters, stats, vectors


def layout(members: DataFrame, x: str = "x", y: str = "y") -> tuple[DataFrame, DataFrame]:
    """(accounts with noise kept and a null centrality as 0, clusters with their ellipse and a one-based name)."""
    users = members.select("user_id", x, y, "cluster_id", F.coalesce("centrality", F.lit(0.0)).alias("centrality"))
    shapes = members.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("size"), *[c.alias(n) for n, c in ellipse(x, y).items()])
    return users, shapes.withColumn("label", F.format_string("Cluster %d", F.col("cluster_id") + 1))


def members_of(clusters_of: DataFrame, users: DataFrame, stat: DataFrame, counts: DataFrame) -> DataFrame:
    """Accounts of a layout with their figures; what is unknown stays null, counts are 0."""
    out = clusters_of.join(users, "user_id", "left").join(stat, "user_id", "left").join(counts, "user_id", "left")
    return out.withColumns(
        {
            "n_selected": F.coalesce("n_selected", F.lit(0)).cast("long"),
            "median_plays": F.col("median_plays").cast("long"),
            "activity_span_months": F.bround(F.col("clip_time_span_days") / 30.0, 0).cast("long"),
        }
    )


def cohort(rows: DataFrame, described: DataFrame, key: str, members: DataFrame, member: str) -> DataFrame:
    """rows that are described, with what describes them, of the members only."""
    return rows.join(described, key).join(members.select(member).where(F.col(member).isNotNull()).distinct(), member, "left_semi")


def ordered_ids(rows: DataFrame, by: str, key: str, name: str) -> DataFrame:
    """by, name: the keys of each group in ascending order."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(key)).alias(name))


def cluster_profile(members: DataFrame, clips: DataFrame, flags: list[str]) -> DataFrame:
    """cluster_id with shares of flags over clips, medians over members, compactness and nearest clusters."""
    _, shapes = layout(members)
    of = members.where("cluster_id >= 0").select("user_id", "cluster_id")
    shares = clips.join(of, "user_id").groupBy("cluster_id").agg(*[stats.share_true(f).alias(f"{f}_share") for f in flags])
    medians = members.where("cluster_id >= 0").groupBy("cluster_id").agg(F.coalesce(F.median("median_plays"), F.lit(0.0)).alias("median_plays"), F.coalesce(F.median("follower_count"), F.lit(0.0)).alias("median_followers"))
    out = shapes.withColumn("compactness", compactness(F.col("rx"), F.col("ry"), F.col("size"))).join(medians, "cluster_id").join(shares, "cluster_id", "left")
    centres = shapes.select(F.col("cluster_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    near = clusters.nearest(shapes.select("cluster_id", "cx", "cy"), centres, F.col("cluster_id"), F.col("cx"), F.col("cy"), 3)
    lists = near.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "nearest_id", "distance"))), lambda n: F.struct(n["nearest_id"].alias("id"), n["distance"].alias("distance"))).alias("nearest"))
    return out.join(lists, "cluster_id", "left")


def creator_profile(members: DataFrame, with_audio: DataFrame, edge_percentile: float = 66.0) -> DataFrame:
    """Accounts in a cluster with audio: distance, percentile, and the nearest other cluster for those near the edge."""
    inside = members.where("cluster_id >= 0").join(with_audio.select("user_id").distinct(), "user_id", "left_semi")
    placed = vectors.centroid_percentile(vectors.member_distances(members.where("cluster_id >= 0"), "cluster_id", "x", "y"), "cluster_id")
    placed = placed.join(inside.select("user_id"), "user_id", "left_semi")
    centres = members.where("cluster_id >= 0").groupBy(F.col("cluster_id").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    near = clusters.nearest(placed.select("user_id", "cluster_id", "x", "y"), centres, F.col("cluster_id"), F.col("x"), F.col("y"), 1)
    near = near.select("user_id", "nearest_id", F.col("distance").alias("nearest_distance"))
    edge = F.col("percentile") >= edge_percentile
    out = placed.join(near, "user_id", "left")
    return out.withColumn("nearest_id", F.when(edge, F.col("nearest_id"))).withColumn("nearest_distance", F.when(edge, F.col("nearest_distance")))


def violations(profile: DataFrame, rules: dict) -> DataFrame:
    """rule, n: rows that break each contract rule (a Column that must be true)."""
    return profile.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()]).unpivot([], list(rules), "rule", "n")
