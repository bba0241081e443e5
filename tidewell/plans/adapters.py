"""The driver's tables as the engine's relations, once as DataFrames and once as SQL with the same literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans.filter_stage import FilterSettings
from tidewell.session import table

#: Thresholds that leave something over in the driver's tables.
SETTINGS = FilterSettings(min_taken_at=1704240000, min_median_plays=30.0, min_clips=30, low_z=-2.0)


def seconds(column: str):
    """Epoch seconds of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("clip_id"),
        "user_id",
        F.col("value").alias("play_count"),
        seconds("ts").alias("taken_at"),
        k.cast("double").alias("video_duration"),
        F.col("event_type").alias("video_url"),
        k.cast("long").alias("like_count"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, x, y, cluster_id (the last of the labels is noise), centrality."""
    rows = table(spark, sf_dir, "embeddings")
    one = rows.select("vec_id", F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"), F.when(F.col("label") == 9, -1).otherwise(F.col("label")).cast("long").alias("cluster_id"))
    return one.withColumn("centrality", F.round(1 / (1 + F.abs("x") + F.abs("y")), 6))


CLIPS = """clips AS (SELECT event_id AS clip_id, user_id, value AS play_count, CAST(floor(epoch(ts)) AS BIGINT) AS taken_at,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS video_duration, event_type AS video_url,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS like_count FROM events)"""

FLAGS = f"""flags AS (SELECT *,
 (coalesce(video_duration <= 0, true) OR coalesce(taken_at <= 0, true) OR coalesce(play_count <= 0, true) OR coalesce(trim(video_url) = '', true) OR like_count IS NULL) AS is_garbage,
 coalesce(video_duration, 0) < {SETTINGS.min_video_duration} AS is_too_short, coalesce(video_duration, 0) > {SETTINGS.max_video_duration} AS is_too_long,
 coalesce(taken_at, 0) < {SETTINGS.min_taken_at} AS is_too_old FROM clips),
 hard AS (SELECT *, NOT (is_garbage OR is_too_short OR is_too_long OR is_too_old) AS is_preprocessed FROM flags)"""

SOFT = f"""med AS (SELECT user_id, median(play_count) AS m FROM hard WHERE is_preprocessed GROUP BY user_id),
 low AS (SELECT u.user_id, coalesce(m < {SETTINGS.min_median_plays}, true) AS is_low_plays_median FROM (SELECT DISTINCT user_id FROM clips) u LEFT JOIN med USING (user_id)),
 joined AS (SELECT h.*, is_low_plays_median FROM hard h LEFT JOIN low USING (user_id)),
 pct AS (SELECT quantile_cont(play_count, {SETTINGS.low_percentile}) AS p_low, quantile_cont(play_count, {SETTINGS.high_percentile}) AS p_high FROM joined WHERE is_preprocessed AND NOT is_low_plays_median),
 soft AS (SELECT j.*, (is_preprocessed AND NOT is_low_plays_median AND play_count < p_low) AS is_low_percentile, (is_preprocessed AND NOT is_low_plays_median AND play_count > p_high) AS is_high_percentile FROM joined j, pct),
 pop AS (SELECT clip_id, user_id, ln(1 + play_count) AS lp FROM soft WHERE is_preprocessed AND NOT is_low_plays_median AND NOT is_low_percentile AND NOT is_high_percentile),
 mid AS (SELECT user_id, median(lp) AS m FROM pop GROUP BY user_id),
 mad AS (SELECT user_id, any_value(m) AS m, median(abs(lp - m)) AS mad FROM pop JOIN mid USING (user_id) GROUP BY user_id),
 z AS (SELECT clip_id, user_id, lp, CASE WHEN mad = 0 THEN 0 ELSE 0.6745 * (lp - m) / mad END AS z FROM pop JOIN mad USING (user_id)),
 fine AS (SELECT s.*, (is_preprocessed AND NOT is_low_percentile AND NOT is_high_percentile AND NOT coalesce(z.z < {SETTINGS.low_z}, false)) AS ok FROM soft s LEFT JOIN z USING (clip_id)),
 few AS (SELECT u.user_id, coalesce(n, 0) < {SETTINGS.min_clips} AS is_not_enough_eligible FROM (SELECT DISTINCT user_id FROM clips) u LEFT JOIN (SELECT user_id, count(*) AS n FROM fine WHERE ok GROUP BY user_id) USING (user_id)),
 owners AS (SELECT user_id, is_low_plays_median, is_not_enough_eligible, NOT (is_low_plays_median OR is_not_enough_eligible) AS is_eligible FROM low JOIN few USING (user_id)),
 eligible AS (SELECT f.clip_id, f.user_id, f.play_count, (f.ok AND o.is_eligible) AS is_eligible FROM fine f JOIN owners o USING (user_id))"""

POOL = f"""ranked AS (SELECT user_id, clip_id, row_number() OVER (PARTITION BY user_id ORDER BY play_count DESC NULLS LAST, clip_id) AS pool_rank, count(*) OVER (PARTITION BY user_id) AS n FROM eligible WHERE is_eligible),
 pool AS (SELECT user_id, clip_id, pool_rank FROM ranked WHERE pool_rank <= greatest({SETTINGS.clips_per_user}, ceil(n * {SETTINGS.pool_share})))"""

MEMBERS = """mem0 AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(CASE WHEN label = 9 THEN -1 ELSE label END AS BIGINT) AS cluster_id FROM embeddings),
 mem AS (SELECT *, round(1 / (1 + abs(x) + abs(y)), 6) AS centrality FROM mem0)"""

SHAPES = """cov AS (SELECT cluster_id, count(*) AS n, avg(x) AS cx, avg(y) AS cy, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b FROM mem WHERE cluster_id >= 0 GROUP BY cluster_id),
 shapes AS (SELECT cluster_id, n, cx, cy, greatest(2 * sqrt(greatest((a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b ** 2), 0)), 1e-6) AS rx, greatest(2 * sqrt(greatest((a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b ** 2), 0)), 1e-6) AS ry, atan2(2 * b, a - c) / 2 AS angle FROM cov)"""
