"""Text columns: cleaning, selection, quality checks, descriptions and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.markers import EXTRAS, PHRASES

# Words that say nothing about a label, and words that no label may have.
STOPWORDS = ("and", "the", "of", "a", "an", "to", "in", "on", "with", "for", "or", "by")
BANNED_WORDS = ("aesthetic", "aesthetics", "curated", "cluster", "vibe", "vibes")

# A label's longest length and its shape, two or three capitalised words.
LABEL_CHARS = 40
LABEL_SHAPE = "^[A-Z][A-Za-z0-9]*(-[A-Za-z0-9]+)?( [A-Z][A-Za-z0-9]*(-[A-Za-z0-9]+)?){1,2}$"

# Characters of words, white space, and the least length of a phrase that marks a longer text.
WORD = "\\p{L}\\p{M}\\p{N}_"
SPACES = "[\\x09-\\x0D\\x1C-\\x20\\x{85}\\p{Z}]+"
MARKER_CHARS = 40

# Descriptor flags and what they are called.
FLAG_NAMES = {
    "is_acoustic": "acoustic",
    "is_electronic": "electronic",
    "is_instrumental": "instrumental",
    "is_happy": "happy",
    "is_sad": "sad",
    "is_party": "party",
    "is_relaxed": "relaxed",
    "is_aggressive": "aggressive",
    "is_female_voice": "female vocal",
    "is_bright_timbre": "bright timbre",
    "is_tonal": "tonal",
}


def nonempty(text: Column) -> Column:
    """The text, or null if it is empty."""
    return F.nullif(text, F.lit(""))


def clean_caption(text: Column) -> Column:
    """Without @mentions, white space collapsed; null becomes empty, which means done."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)@[\\w.]+", "")
    return F.trim(F.regexp_replace(bare, "(?U)\\s+", " "))


def normalised(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "\\s+", " "))


def select_text(lang: Column, translation: Column, clean: Column, raw: Column | None = None) -> Column:
    """The translation of a text in another language, else its cleaned form, else the raw one, else empty."""
    from tidewell.functions.predicates import blank, english

    own = F.coalesce(nonempty(clean), *([nonempty(raw)] if raw is not None else []), F.lit(""))
    return F.when(~english(lang) & ~blank(translation), translation).otherwise(own)


def joined_text(*parts: Column) -> Column:
    """Parts that are not blank, with bars between; null if there is none."""
    return nonempty(F.concat_ws(" | ", *[F.when(F.trim(p) != "", p) for p in parts]))


def letters(text: Column) -> Column:
    """Number of Latin and Cyrillic letters."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-zÀ-ɏЀ-ӿ]+", ""))


def meaningful(text: Column, least: int = 8) -> Column:
    return letters(text) >= least


def too_short_text(text: Column, least: int = 5) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < least


def low_letter_ratio(text: Column, least: float = 0.3) -> Column:
    """Few letters among what is no white space; blank texts count as low."""
    seen = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", ""))
    return F.when(seen == 0, True).otherwise(letters(text) / F.nullif(seen, F.lit(0)) < least)


def repeated_output(text: Column, times: int = 5) -> Column:
    """One word so many times in a row, whatever its case, which is lowered letter by letter, and what stands between."""
    words = F.lower(F.translate(F.coalesce(text, F.lit("")), "İΣ", "iσ"))
    return words.rlike(f"(?<![{WORD}])([{WORD}]+)(?:[^{WORD}]+\\1(?![{WORD}])){{{times - 1}}}")


def anywhere(phrases: Sequence[str] = PHRASES, extras: Sequence[str] = EXTRAS) -> list[str]:
    """Phrases that count within a longer text."""
    return [p for p in phrases if len(p) >= MARKER_CHARS or p in extras]


def known_marker(text: Column, phrases: Sequence[str] = PHRASES, extras: Sequence[str] = EXTRAS) -> Column:
    """Is one of the phrases, which are in lower case, or contains a long one or an extra, whatever the case and white space."""
    bare = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACES, " "))
    found = bare.isin(*phrases)
    for phrase in anywhere(phrases, extras):
        found = found | F.contains(bare, F.lit(phrase))
    return found


def dirty_transcript(text: Column, log_probability: Column, compression: Column, marked: Column) -> Column:
    """Unlikely or overcompressed (only for a text), too short, few letters, repeated, or with a known marker phrase."""
    some = F.length(F.coalesce(text, F.lit(""))) > 0
    model = some & F.coalesce((log_probability < -0.8) | (compression > 2.4), F.lit(False))
    return model | too_short_text(text) | low_letter_ratio(text) | repeated_output(F.translate(text, "ς", "σ")) | marked


def first_labels(csv: Column, k: int) -> Column:
    """The first k labels of a comma-separated list, blanks left out."""
    parts = F.filter(F.transform(F.split(F.coalesce(csv, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.slice(parts, 1, k)


def label_scores(labels: Column, scores: Column) -> Column:
    """array<struct<label, score>> of two comma-separated lists; empty unless they match and all scores are numbers."""
    kept = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    numbers = F.transform(kept(scores), lambda s: F.expr("0D") + s.try_cast("double"))
    good = (F.size(kept(labels)) == F.size(numbers)) & ~F.exists(numbers, F.isnull)
    zipped = F.zip_with(kept(labels), numbers, lambda a, b: F.struct(a.alias("label"), b.alias("score")))
    return F.when(good, zipped).otherwise(F.array().cast("array<struct<label:string,score:double>>"))


def bucket(value: Column, high: float, low: float, names: tuple[str, str, str]) -> Column:
    return F.when(value >= high, names[0]).when(value >= low, names[1]).when(value.isNotNull(), names[2])


# Limits and names of the three scores' bands.
def danceability(value: Column) -> Column:
    return bucket(value, 0.66, 0.33, ("highly danceable", "moderately danceable", "low danceability"))


def engagement(value: Column) -> Column:
    return bucket(value, 7.0, 4.0, ("highly engaging", "moderately engaging", "low engagement"))


def approachability(value: Column) -> Column:
    return bucket(value, 7.0, 4.0, ("very approachable", "moderately approachable", "low approachability"))


def describe_audio() -> Column:
    """A sentence over genre_labels, moodtheme_labels, instrument_labels, the flags and the three scores; empty sections are left out."""
    listed = lambda name, k: nonempty(F.array_join(first_labels(F.col(name), k), ", "))
    tail = nonempty(F.concat_ws(", ", listed("moodtheme_labels", 3), listed("instrument_labels", 2)))
    head = nonempty(F.concat_ws(" — ", listed("genre_labels", 2), tail))
    flags = nonempty(F.concat_ws(", ", *[F.when(F.col(c), F.lit(name)) for c, name in FLAG_NAMES.items()]))
    buckets = nonempty(F.concat_ws(", ", danceability(F.col("danceability")), engagement(F.col("engagement")), approachability(F.col("approachability"))))
    body = nonempty(F.concat_ws("; ", head, F.concat(F.lit("flags: "), flags), buckets))
    return F.coalesce(F.concat(F.lit("Music: "), body), F.lit(""))


def _short(value: float) -> str:
    for size, unit in ((1_000_000, "M"), (1_000, "k")):
        if value >= size:
            return f"{value / size:.1f}".rstrip("0").rstrip(".") + unit
    return f"{value:g}"


# A decade's steps and the names of the first and last band of followers.
def follower_edges() -> list[float]:
    """Steps of a decade, for nine decades up to 1e9."""
    return [m * 10**k for k in range(9) for m in (1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 7.0)] + [1e9]


def follower_names() -> list[tuple[float, float, str]]:
    """(from, below, name) of each band under 100M."""
    edges = follower_edges()
    return [(a, b, f"{_short(a)}–{_short(b)}") for a, b in zip(edges, edges[1:], strict=False) if a < 1e8]


def follower_bucket(count: Column) -> Column:
    out = F.when(count < 1, "<1").when(count >= 1e8, "100M+")
    for low, high, name in follower_names():
        out = out.when((count >= low) & (count < high), name)
    return out


def content_words(label: Column) -> Column:
    """Distinct lower-case words of more than two characters that are no stopwords; hyphens separate too."""
    words = F.split(F.lower(F.regexp_replace(label, "-", " ")), "\\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS)))


def valid_label(label: Column) -> Column:
    text = F.trim(label)
    fine = (F.length(text) <= LABEL_CHARS) & text.rlike(LABEL_SHAPE) & ~F.arrays_overlap(content_words(text), F.array(*[F.lit(w) for w in BANNED_WORDS]))
    return F.coalesce(fine, F.lit(False))


def hashtag_like(tag: Column) -> Column:
    """Begins with # or @, or is a single word."""
    return F.trim(tag).rlike("(?U)^([#@].*|\\w+)$")


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def compact(count: Column) -> Column:
    """1234 as 1.2k, 5600000 as 5.6M."""
    one = lambda size, unit: F.concat(F.regexp_replace(F.format_string("%.1f", count / size), "\\.0$", ""), F.lit(unit))
    return F.when(count >= 1_000_000, one(1e6, "M")).when(count >= 1_000, one(1e3, "k")).otherwise(count.cast("long").cast("string"))


def genre_leaf(genre: Column, children: dict[str, str]) -> Column:
    """The child of a flattened "Parent Child" name; unknown names pass."""
    pairs = [F.lit(x) for item in children.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[genre], genre) if pairs else genre


def quoted(text: Column) -> Column:
    """text in quotes, with backslashes and control characters escaped, as a Python literal shows it."""
    for plain, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(single)


# The longest body that a failure message holds whole, and the length of its two ends otherwise.
WHOLE_BODY, BODY_END = 5000, 1500


def failure_message(code: Column, body: Column) -> Column:
    """Code, length and body; of a long body its two ends. Line ends are written out before the body is quoted."""
    shown = lambda part: quoted(F.replace(part, F.lit("\n"), F.lit("\\n")))
    head, tail = F.substring(body, 1, BODY_END), F.right(body, F.lit(BODY_END))
    whole = F.concat(F.lit(" body="), shown(body))
    ends = F.concat(F.lit(" head="), shown(head), F.lit(" tail="), shown(tail))
    return F.concat(code, F.lit(" len="), F.length(body).cast("string"), F.when(F.length(body) <= WHOLE_BODY, whole).otherwise(ends))


def clean_speech(frame: DataFrame, markers: list[str]) -> DataFrame:
    """frame with the speech columns emptied where detected speech has a translation that contains one of the markers."""
    from tidewell.functions.predicates import has_detected_speech

    poisoned = F.lit(False)
    for marker in markers:
        poisoned = poisoned | F.contains(F.col("speech_translation"), F.lit(marker))
    poisoned = has_detected_speech() & F.coalesce(poisoned, F.lit(False))
    emptied = {c: F.when(~poisoned, F.col(c)).alias(c) for c in SPEECH_COLUMNS if c in frame.columns}
    return frame.withColumns(emptied | {"is_speech_detected": F.when(poisoned, F.lit(False)).otherwise(F.col("is_speech_detected"))})


def sandwich_input(visual_json: Column, text: Column) -> Column:
    """Visual observations, as JSON with sorted keys, and the joined text; null without observations."""
    return F.concat(F.lit("VISUAL_OBSERVATIONS="), visual_json, F.lit("\n\nTEXT="), F.coalesce(text, F.lit("")))


def music_input(is_music_detected: Column, description: Column) -> Column:
    """The description of the audio, null unless music was detected."""
    return F.when(F.coalesce(is_music_detected, F.lit(False)), description)


def language_or_undetermined(code: Column) -> Column:
    """What a language detector said, lower-cased; "und" if it said nothing."""
    return F.coalesce(nonempty(F.lower(F.trim(code))), F.lit("und"))


# What speech detection writes besides its flag.
SPEECH_COLUMNS = ("speech_transcription", "speech_language", "speech_translation", "speech_confidence", "speech_avg_logprob", "speech_compression_ratio")
