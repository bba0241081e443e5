"""Grouped statistics of accounts and their clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.quantiles import exact_quantiles

#: Makes a median absolute deviation comparable with a standard deviation.
MAD_SCALE = 0.6745


def share_true(flag: str | Column) -> Column:
    """True among non-null values; 0 without any."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    return F.coalesce(F.avg(flag.cast("double")), F.lit(0.0))


def with_mad(frame: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, median and median absolute deviation of a column: two grouped medians."""
    middle = frame.groupBy(*keys).agg(F.median(column).alias("_median"))
    away = frame.join(middle, keys).select(*keys, "_median", F.abs(F.col(column) - F.col("_median")).alias("_away"))
    return away.groupBy(*keys).agg(F.first("_median").alias("median"), F.median("_away").alias("mad"))


def user_stats(clips: DataFrame) -> DataFrame:
    """Counts, plays, spread, concentration and cadence of each account; accounts without clips have no row."""
    logged = clips.withColumn("log_plays", F.log1p("play_count"))
    spread = with_mad(logged.select("user_id", "log_plays"), ["user_id"], "log_plays").select("user_id", F.col("mad").alias("log_plays_mad"))
    days = (F.max("taken_at") - F.min("taken_at")) / 86400.0
    median, top, total = F.median("play_count"), F.max("play_count"), F.sum("play_count")
    out = logged.groupBy("user_id").agg(
        F.count("*").alias("n_clips"),
        median.alias("median_plays"),
        F.avg("play_count").alias("mean_plays"),
        top.alias("max_plays"),
        F.min("play_count").alias("min_plays"),
        F.avg("log_plays").alias("mean_log_plays"),
        F.median("log_plays").alias("median_log_plays"),
        F.stddev_pop("log_plays").alias("log_plays_std"),
        F.when(median > 0, top / F.nullif(median, F.lit(0))).alias("top_to_median_plays_ratio"),
        F.when(total > 0, top / F.nullif(total, F.lit(0))).alias("share_of_plays_from_top_clip"),
        F.avg("video_duration").alias("mean_video_duration"),
        F.median("video_duration").alias("median_video_duration"),
        F.min("taken_at").alias("oldest_clip_taken_at"),
        F.max("taken_at").alias("newest_clip_taken_at"),
        days.alias("clip_time_span_days"),
        F.when(days > 0, F.count("*") / F.nullif(days / 7.0, F.lit(0.0))).alias("approx_clips_per_week"),
    )
    return out.join(spread, "user_id")


def low_median(users: DataFrame, clips: DataFrame, least: float) -> DataFrame:
    """user_id, is_low_plays_median: below ``least``, or no plays at all."""
    middle = clips.where("play_count IS NOT NULL").groupBy("user_id").agg(F.median("play_count").alias("m"))
    return users.select("user_id").distinct().join(middle, "user_id", "left").select("user_id", F.coalesce(F.col("m") < least, F.lit(True)).alias("is_low_plays_median"))


def too_few(users: DataFrame, clips: DataFrame, counted: Column, least: int, name: str) -> DataFrame:
    """user_id and whether under ``least`` clips satisfy ``counted``; accounts without clips have none."""
    counts = clips.groupBy("user_id").agg(F.count_if(counted).alias("n"))
    return users.select("user_id").distinct().join(counts, "user_id", "left").select("user_id", (F.coalesce("n", F.lit(0)) < least).alias(name))


def percentile_flags(clips: DataFrame, population: Column, low: float, high: float) -> DataFrame:
    """clips with is_low_percentile and is_high_percentile, against exact quantiles of the population; false outside it."""
    p_low, p_high = exact_quantiles(clips.where(population), "play_count", [low, high])
    inside = F.coalesce(population, F.lit(False))
    return clips.withColumn("is_low_percentile", F.coalesce(inside & (F.col("play_count") < F.lit(p_low)), F.lit(False))).withColumn("is_high_percentile", F.coalesce(inside & (F.col("play_count") > F.lit(p_high)), F.lit(False)))


def robust_z(clips: DataFrame, threshold: float) -> DataFrame:
    """clip_id, user_id, log_plays, creator_relative_robust_z, is_creator_low_outlier; z is 0 where nothing deviates."""
    logged = clips.select("clip_id", "user_id", F.log1p("play_count").alias("log_plays"))
    joined = logged.join(with_mad(logged, ["user_id"], "log_plays"), "user_id")
    z = F.when(F.col("mad") == 0, 0.0).otherwise(MAD_SCALE * (F.col("log_plays") - F.col("median")) / F.nullif(F.col("mad"), F.lit(0.0)))
    return joined.select("clip_id", "user_id", "log_plays", z.alias("creator_relative_robust_z"), (z < threshold).alias("is_creator_low_outlier"))


def ranked(frame: DataFrame, keys: list[str], order: list[Column], name: str = "rk") -> DataFrame:
    """Row numbers within keys, as longs."""
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def label_topk(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, label, weight, rk: summed scores as shares of the largest; zeros if that is zero."""
    sums = scored.groupBy(*keys, "label").agg(F.sum("score").alias("total"))
    top = ranked(sums, keys, [F.desc("total"), F.asc("label")]).where(F.col("rk") <= k)
    best = F.max("total").over(Window.partitionBy(*keys))
    return top.select(*keys, "label", F.when(best > 0, F.col("total") / F.nullif(best, F.lit(0.0))).otherwise(0.0).alias("weight"), "rk")


def top_shares(frame: DataFrame, keys: list[str], code: str, k: int) -> DataFrame:
    """keys, code, n, share, rk: counts of codes, as shares of all that are neither null nor empty."""
    counts = frame.where(F.coalesce(F.col(code) != "", F.lit(False))).groupBy(*keys, code).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return ranked(counts.withColumn("share", share), keys, [F.desc("n"), F.asc(code)]).where(F.col("rk") <= k)


def distinctiveness(frame: DataFrame, cohort: str, features: list[str], least: float, k: int) -> DataFrame:
    """cohort, feature, cohort_value, baseline_mean, baseline_std, z, rk: cohort means that stand out from all rows."""
    long = frame.select(cohort, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), F.lit(i).alias("place")) for i, f in enumerate(features)])))
    base = long.groupBy("feature").agg(F.avg("value").alias("baseline_mean"), F.stddev_pop("value").alias("baseline_std"))
    own = long.groupBy(cohort, "feature", "place").agg(F.avg("value").alias("cohort_value"))
    z = (F.col("cohort_value") - F.col("baseline_mean")) / F.col("baseline_std")
    found = own.join(base.where("baseline_std > 0"), "feature").withColumn("z", z).where(F.abs("z") >= least)
    return ranked(found, [cohort], [F.desc(F.abs(F.round("z", 4))), F.asc("place")]).where(F.col("rk") <= k).drop("place")


def leave_one_out(frame: DataFrame, cohort: str, member: str, feature: str) -> DataFrame:
    """cohort, member, z of each member's mean against all other members' rows of its cohort.

    Counts, means and centred squares of a member are taken out of its cohort's, so large values do not cancel.
    """
    v = F.col(feature).cast("double")
    moments = lambda rows, tag: rows.agg(F.count(v).alias(f"_n{tag}"), F.avg(v).alias(f"_mean{tag}"), (F.var_pop(v) * F.count(v)).alias(f"_squares{tag}"))
    own = moments(frame.groupBy(cohort, member), "")
    joined = own.join(moments(frame.groupBy(F.col(cohort).alias("_cohort")), "_all"), F.col(cohort).eqNullSafe(F.col("_cohort"))).where("_n > 0 AND _n_all > _n")
    rest = joined.withColumn("_rest", F.col("_n_all") - F.col("_n"))
    rest = rest.withColumn("_gap", (F.col("_mean") - F.col("_mean_all")) * F.col("_n_all") / F.col("_rest"))
    squares = F.col("_squares_all") - F.col("_squares") - F.col("_gap") * F.col("_gap") * F.col("_n") * F.col("_rest") / F.col("_n_all")
    return rest.withColumn("_var", squares / F.col("_rest")).where("_var > 1e-12").select(cohort, member, (F.col("_gap") / F.sqrt("_var")).alias("z"))


def selection_pool(clips: DataFrame, k: int, share: float) -> DataFrame:
    """user_id, clip_id, pool_rank: an account's most played clips, k or a share of them, whichever is more."""
    n = F.count("*").over(Window.partitionBy("user_id"))
    top = ranked(clips.select("user_id", "clip_id", "play_count", n.alias("_n")), ["user_id"], [F.desc_nulls_last("play_count"), F.asc("clip_id")], "pool_rank")
    return top.where(F.col("pool_rank") <= F.greatest(F.lit(k), F.ceil(F.col("_n") * share))).select("user_id", "clip_id", "pool_rank")


def seeded_sample(pool: DataFrame, k: int, seed: int) -> DataFrame:
    """user_id, clip_id: up to k of an account's pool, by a hash that no other account changes."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("user_id").cast("string"), F.col("clip_id").cast("string")), 256)
    return ranked(pool.withColumn("_key", key), ["user_id"], [F.asc("_key"), F.asc("clip_id")]).where(F.col("rk") <= k).select("user_id", "clip_id")


def mersenne_sample(pool: DataFrame, k: int, seed: int) -> DataFrame:
    """The same with Python's generator seeded by "seed:account"; for parity, not for scale."""

    def pick(rows):
        import random

        ids = rows.sort_values("pool_rank")["clip_id"].tolist()
        rows = rows.iloc[: min(k, len(ids))].copy()
        rows["clip_id"] = random.Random(f"{seed}:{rows['user_id'].iloc[0]}").sample(ids, min(k, len(ids)))
        return rows[["user_id", "clip_id"]]

    return pool.select("user_id", "clip_id", "pool_rank").groupBy("user_id").applyInPandas(pick, "user_id long, clip_id long")


def segment_stats(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Mean log probability and compression, and 1 minus the mean no-speech probability, between 0 and 1."""
    sure = F.greatest(F.least(1 - F.avg("no_speech_prob"), F.lit(1.0)), F.lit(0.0))
    return segments.groupBy(*keys).agg(F.avg("avg_logprob").alias("avg_logprob"), F.avg("compression_ratio").alias("compression_ratio"), sure.alias("confidence"))


def bounds(frame: DataFrame, x: str, y: str) -> DataFrame:
    """min_x, max_x, min_y, max_y; -1 and 1 for an empty frame."""
    return frame.agg(*[F.coalesce(f(c), F.lit(d)).alias(f"{n}_{a}") for a, c in (("x", x), ("y", y)) for n, f, d in (("min", F.min, -1.0), ("max", F.max, 1.0))])

