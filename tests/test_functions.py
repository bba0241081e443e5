"""Columns against hand-computed cases."""

import math

from pyspark.sql import functions as F

from tidewell.functions import geometry as G
from tidewell.functions import predicates as P
from tidewell.functions import text as X


def one(spark, column, **values):
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items()) or "_ int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column).first()[0]


CLIP = {"video_duration": 10.0, "taken_at": 1700000000, "play_count": 5000, "video_url": "http://example.com/v.mp4", "like_count": 100}


def test_garbage(spark):
    assert one(spark, P.garbage(), **CLIP) is False
    for name, value in (("video_duration", 0.0), ("taken_at", 0), ("play_count", 0), ("video_url", "  ")):
        assert one(spark, P.garbage(), **CLIP | {name: value}) is True
    for name in CLIP:
        frame = spark.createDataFrame([tuple(CLIP.values())], ", ".join(f"{k} {'string' if k == 'video_url' else 'double' if k == 'video_duration' else 'long'}" for k in CLIP))
        frame = frame.withColumn(name, F.lit(None).cast(dict(frame.dtypes)[name]))
        assert frame.select(P.garbage()).first()[0] is True
    assert one(spark, P.garbage(), **CLIP | {"like_count": 0}) is False


def test_flags_ignore_null(spark):
    frame = spark.createDataFrame([(None, False), (None, True)], "a boolean, b boolean")
    assert [r[0] for r in frame.select(P.any_flag("a", "b")).collect()] == [False, True]


def test_english(spark):
    frame = spark.createDataFrame([("en",), ("EN-us",), ("enm",), ("fr",), (None,)], "l string")
    assert [r[0] for r in frame.select(P.english("l")).collect()] == [True, True, True, False, False]


def test_passes_filter(spark):
    frame = spark.createDataFrame([(0.2, 8, 30, 100), (0.5, 8, 30, 100), (0.2, 2, 30, 100), (0.2, 8, 60, 100), (1.0, 8, 0, 100)], "noise_ratio double, n_clusters long, max_size long, n_users long")
    assert [r[0] for r in frame.select(P.passes_filter(0.4, 5, 20, 0.5)).collect()] == [True, False, False, False, False]


def test_clean_caption(spark):
    for raw, clean in (("hi @some.one  there\n", "hi there"), (None, ""), ("@é only", "only"), ("", "")):
        frame = spark.createDataFrame([(raw,)], "t string")
        assert frame.select(X.clean_caption(F.col("t"))).first()[0] == clean


def test_follower_bucket(spark):
    for n, name in ((0, "<1"), (999, "700–1k"), (1000, "1k–1.5k"), (99_999_999, "70M–100M"), (100_000_000, "100M+")):
        assert one(spark, X.follower_bucket(F.col("n")), n=n) == name


def test_label_scores(spark):
    good = one(spark, X.label_scores(F.col("a"), F.col("b")), a="house, techno", b="0.8, 0.2")
    assert [(x["label"], x["score"]) for x in good] == [("house", 0.8), ("techno", 0.2)]
    for a, b in (("a, b", "1"), ("a", "x"), ("", "")):
        assert one(spark, X.label_scores(F.col("a"), F.col("b")), a=a, b=b) == []


def test_repeated_output(spark):
    for t, expected in (("no No NO, no no", True), ("no no no no", False), ("a no no no no now", False), ("", False)):
        assert one(spark, X.repeated_output(F.col("t")), t=t) is expected


def test_quality(spark):
    assert one(spark, X.low_letter_ratio(F.col("t")), t="12345 a") is True
    assert one(spark, X.low_letter_ratio(F.col("t")), t="   ") is True
    assert one(spark, X.meaningful(F.col("t")), t="Привет мир") is True
    assert one(spark, X.too_short_text(F.col("t")), t=" abc ") is True


def test_labels(spark):
    for label, expected in (("Warm Neon Nights", True), ("warm neon", False), ("One", False), ("Curated Neon", False), ("Hip-Hop Scene", True), ("A" * 39 + " B", False)):
        assert one(spark, X.valid_label(F.col("t")), t=label) is expected
    for tag, expected in (("#x y", True), ("word", True), ("two words", False)):
        assert one(spark, X.hashtag_like(F.col("t")), t=tag) is expected


def test_audio_description(spark):
    values = {"genre_labels": "house, techno, pop", "moodtheme_labels": "relaxed, mellow", "instrument_labels": "synth", "danceability": 0.5, "engagement": 7.0, "approachability": 1.0} | {c: c == "is_tonal" for c in X.FLAG_NAMES}
    assert one(spark, X.describe_audio(), **values) == "Music: house, techno — relaxed, mellow, synth; flags: tonal; moderately danceable, highly engaging, low approachability"


def test_unit_hash(spark):
    def expected(h):
        h ^= h >> 16
        h = h * 0x85EBCA6B % 2**32
        h ^= h >> 13
        h = h * 0xC2B2AE35 % 2**32
        return (h ^ (h >> 16)) / (2**32 - 1)

    for n in (0, 1, 123456, 2**31):
        assert math.isclose(one(spark, G.unit_hash(F.col("n")), n=n), expected(n))


def test_ellipse(spark):
    line = spark.createDataFrame([(float(i), float(i)) for i in range(10)], "x double, y double")
    row = line.agg(*[c.alias(n) for n, c in G.ellipse("x", "y").items()]).first()
    assert math.isclose(abs(row["angle"]), math.pi / 4, abs_tol=1e-9) and row["ry"] < 1e-3
    point = spark.createDataFrame([(1.0, 2.0)], "x double, y double").agg(*[c.alias(n) for n, c in G.ellipse("x", "y").items()]).first()
    assert point["rx"] < 1e-3 and point["angle"] == 0
    assert math.isclose(one(spark, G.compactness(F.col("a"), F.col("b"), F.col("n")), a=0.82, b=0.31, n=42), math.pi * 0.82 * 0.31 / 42)
