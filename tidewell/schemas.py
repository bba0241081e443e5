"""Declared schemas of the relations and label documents; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = {
    "users": "id long, following_count int, follower_count int, parse_status string, is_low_plays_median boolean, is_not_enough_preprocessed boolean, is_not_enough_eligible boolean, is_eligible boolean, is_selected boolean",
    "clips": "id long, user_id long, video_url string, thumbnail_url string, caption_text string, caption_clean string, caption_language string, caption_translation string, play_count long, like_count long, video_duration double, taken_at long, speech_transcription string, speech_language string, speech_confidence double, speech_avg_logprob double, speech_compression_ratio double, speech_translation string, is_speech_detected boolean, is_garbage boolean, is_too_short boolean, is_too_long boolean, is_too_old boolean, is_low_percentile boolean, is_high_percentile boolean, is_preprocessed boolean, is_eligible boolean, is_selected boolean, is_downloaded boolean",
    "audio": "clip_id long, is_mir_extracted boolean, is_music_detected boolean, mir_error string, approachability double, engagement double, danceability double, is_acoustic boolean, is_electronic boolean, is_instrumental boolean, is_happy boolean, is_sad boolean, is_party boolean, is_relaxed boolean, is_aggressive boolean, is_female_voice boolean, is_bright_timbre boolean, is_tonal boolean, genre_labels string, genre_scores string, instrument_labels string, instrument_scores string, moodtheme_labels string, moodtheme_scores string",
    "clip_embeddings": "clip_id long, embedding_case string, embedding array<float>, source_hash string",
    "user_embeddings": "user_id long, embedding_case string, embedding array<float>, source_hash string",
    "user_clusters": "user_id long, embedding_case string, cluster_id long, x double, y double, centrality double",
    "cluster_metrics": "embedding_case string, cluster_id long, n_users long, mean_centrality double, high_conf_fraction double",
    "clip_labels": "clip_id long, label_case string, status string, validation string, payload string, warnings array<string>, error string, attempts long, generation_seed long, source_hash string",
    "cluster_labels": "embedding_case string, cluster_id long, status string, validation string, payload string, warnings array<string>, error string, attempts long, generation_seed long, source_hash string, sampled_clip_ids array<long>",
}

GROUNDED = "array<struct<tag:string,grounded_in:array<string>,confidence:string>>"


def clip_label(observable: str = "observable_visual_tags", sentence: str = "one_sentence_visual_reading") -> str:
    """A clip label's type; two of its keys depend on the case."""
    return f"struct<{observable}:array<struct<tag:string,evidence:string>>,aesthetic_tags:{GROUNDED},community_signalling_tags:{GROUNDED},{sentence}:string>"


def cluster_label(repertoire: str = "visual_repertoire") -> str:
    """A cluster label's type."""
    signal = "struct<label:string,description:string,confidence:string>"
    return f"struct<cluster_label:string,cluster_summary:string,boundary_notes:string,{repertoire}:array<struct<tag:string,description:string,recurrence:string>>,dominant_aesthetic_logic:array<struct<tag:string,grounded_in:array<string>,description:string>>,taste_signalling:{signal},visibility_orientation:{signal},internal_variations:array<struct<variation:string,description:string>>,tool_tags:array<string>>"


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def conform(frame: DataFrame, name: str) -> DataFrame:
    """frame in a table's columns and types; columns that are missing are null, others are left out."""
    return frame.select(*[(F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name).fields])
