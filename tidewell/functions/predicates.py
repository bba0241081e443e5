"""Boolean columns over clips. A flag counts only if it is true: null means not computed yet."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

HARD_FLAGS = ("is_garbage", "is_too_short", "is_too_long", "is_too_old")
SOFT_FLAGS = ("is_low_percentile", "is_high_percentile")


def is_true(flag: str | Column) -> Column:
    """The flag, with null as false."""
    return F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False))


def any_flag(*flags: str) -> Column:
    """Whether at least one flag is true."""
    return reduce(or_, [is_true(f) for f in flags])


def blank(text: str | Column) -> Column:
    """Null, empty or white space only."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.trim(text) == "", F.lit(True))


def _not_positive(name: str) -> Column:
    return F.coalesce(F.col(name) <= 0, F.lit(True))


def garbage() -> Column:
    """No duration, time or plays above zero, no url, or unknown likes; no likes are fine."""
    return _not_positive("video_duration") | _not_positive("taken_at") | _not_positive("play_count") | blank("video_url") | F.col("like_count").isNull()


def too_short(least: float) -> Column:
    return F.coalesce(F.col("video_duration"), F.lit(0)) < least


def too_long(most: float) -> Column:
    return F.coalesce(F.col("video_duration"), F.lit(0)) > most


def too_old(least: int) -> Column:
    return F.coalesce(F.col("taken_at"), F.lit(0)) < least


def used_in_analysis() -> Column:
    """Selected and downloaded."""
    return is_true("is_selected") & is_true("is_downloaded")


def needs_speech_detection() -> Column:
    return used_in_analysis() & F.col("is_speech_detected").isNull()


def has_detected_speech() -> Column:
    return used_in_analysis() & is_true("is_speech_detected")


def english(lang: str | Column) -> Column:
    """Language codes that begin with en in any case; null is not English."""
    lang = F.col(lang) if isinstance(lang, str) else lang
    return F.coalesce(F.startswith(F.lower(lang), F.lit("en")), F.lit(False))


def _missing(name: str) -> Column:
    return F.coalesce(F.col(name) == "", F.lit(True))


def needs_speech_translation() -> Column:
    return has_detected_speech() & ~_missing("speech_transcription") & ~_missing("speech_language") & ~english("speech_language") & _missing("speech_translation")


def needs_caption_cleaning() -> Column:
    return used_in_analysis() & ~blank("caption_text") & F.col("caption_clean").isNull()


def needs_caption_language() -> Column:
    return used_in_analysis() & ~blank("caption_clean") & _missing("caption_language")


def needs_caption_translation() -> Column:
    """A language that could not be determined is not translated."""
    return used_in_analysis() & ~blank("caption_clean") & ~_missing("caption_language") & (F.col("caption_language") != "und") & ~english("caption_language") & _missing("caption_translation")


def positive_head(scores: Column, least: float = 0.5) -> Column:
    """A two-way classifier's verdict: its first score, the positive one, is at least the threshold."""
    return F.coalesce(F.get(scores, F.lit(0)) >= least, F.lit(False))


def label_pending() -> Column:
    """Over an outer-joined label: no row yet, or waiting."""
    return F.col("status").isNull() | (F.col("status") == "pending")


def label_done() -> Column:
    return F.coalesce(F.col("status") == "success", F.lit(False))


def label_selected(max_attempts: int) -> Column:
    """No row, waiting, or failed with attempts left."""
    return label_pending() | ((F.col("status") == "failed") & (F.col("attempts") < max_attempts))


def fresh(out_mtime: Column, source_mtime: Column) -> Column:
    """An output at least as new as its source; both must exist."""
    return F.coalesce(out_mtime >= source_mtime, F.lit(False))


def passes_filter(most_noise: float, least_k: int, most_k: int, most_dominance: float) -> Column:
    """Over n_clusters, noise_ratio, max_size and n_users of a run."""
    assigned = F.col("n_users") - F.bround(F.col("noise_ratio") * F.col("n_users"), 0)
    dominance = F.when(assigned > 0, F.col("max_size") / assigned).otherwise(1.0)
    ok = (F.col("noise_ratio") <= most_noise) & F.col("n_clusters").between(least_k, most_k)
    return ok if most_dominance >= 1 else ok & (dominance <= most_dominance)
