"""The filter stage as one lazy plan: flags, account statistics, eligibility, selection.

Percentiles and robust z see accounts excluded by a low median only, since whether an account has enough eligible
clips is not known before them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import predicates as P
from tidewell.operators import stats


@dataclass(frozen=True)
class FilterSettings:
    """Thresholds; the defaults are the production ones."""

    min_video_duration: float = 3
    max_video_duration: float = 80
    min_taken_at: int = 1640995200
    min_median_plays: float = 10000
    min_clips: int = 30
    low_percentile: float = 0.05
    high_percentile: float = 0.99
    low_z: float = -3.5
    pool_share: float = 0.20
    clips_per_user: int = 10
    seed: int = 42


def hard_flags(clips: DataFrame, settings: FilterSettings) -> DataFrame:
    """clips with the four hard flags and is_preprocessed."""
    flagged = clips.withColumns(
        {
            "is_garbage": P.garbage(),
            "is_too_short": P.too_short(settings.min_video_duration),
            "is_too_long": P.too_long(settings.max_video_duration),
            "is_too_old": P.too_old(settings.min_taken_at),
        }
    )
    return flagged.withColumn("is_preprocessed", ~P.any_flag(*P.HARD_FLAGS))


def soft_flags(clips: DataFrame, settings: FilterSettings) -> DataFrame:
    """hard_flags() with the account's median flag, the percentile flags and is_creator_low_outlier."""
    flagged = hard_flags(clips, settings)
    low = stats.low_median(clips, flagged.where("is_preprocessed"), settings.min_median_plays)
    joined = flagged.join(low, "user_id", "left")
    population = P.is_true("is_preprocessed") & ~P.is_true("is_low_plays_median")
    marked = stats.percentile_flags(joined, population, settings.low_percentile, settings.high_percentile)
    clean = marked.where(population & ~P.any_flag(*P.SOFT_FLAGS))
    z = stats.robust_z(clean, settings.low_z).select("clip_id", "log_plays", "creator_relative_robust_z", "is_creator_low_outlier")
    return marked.join(z, "clip_id", "left").withColumn("is_creator_low_outlier", P.is_true("is_creator_low_outlier"))


def eligibility(clips: DataFrame, settings: FilterSettings) -> tuple[DataFrame, DataFrame]:
    """(clips with is_eligible, accounts with their flags and is_eligible)."""
    marked = soft_flags(clips, settings)
    fine = P.is_true("is_preprocessed") & ~P.any_flag(*P.SOFT_FLAGS) & ~P.is_true("is_creator_low_outlier")
    few = stats.too_few(clips, marked, fine, settings.min_clips, "is_not_enough_eligible")
    users = marked.select("user_id", "is_low_plays_median").distinct().join(few, "user_id")
    users = users.withColumn("is_eligible", ~P.any_flag("is_low_plays_median", "is_not_enough_eligible"))
    owners = users.select("user_id", F.col("is_eligible").alias("_owner"))
    return marked.join(owners, "user_id", "left").withColumn("is_eligible", fine & P.is_true("_owner")).drop("_owner"), users


def selection(clips: DataFrame, settings: FilterSettings) -> DataFrame:
    """user_id, clip_id of the sample of eligible clips."""
    eligible = eligibility(clips, settings)[0].where("is_eligible")
    return stats.seeded_sample(stats.selection_pool(eligible, settings.clips_per_user, settings.pool_share), settings.clips_per_user, settings.seed)
