"""Relations against hand-computed cases."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.operators import clusters, labels, profiles, quantiles, relational, serving, stats, vectors
from tidewell.plans import ledger, plugins
from tidewell.plans.filter_stage import FilterSettings, eligibility, hard_flags, selection
from tidewell.sources import readers

CLIP = "clip_id long, user_id long, play_count double, taken_at long, video_duration double, video_url string, like_count long"


def clip_rows(plays, user=1, first=0, step=0):
    return [(first + i, user, p, 1700000000 + i * step, 10.0, "http://v", 1) for i, p in enumerate(plays)]


def test_user_stats(spark):
    row = stats.user_stats(spark.createDataFrame(clip_rows([1.0, 1.0, 1.0, 7.0], step=86400 * 7 // 3), CLIP)).first()
    assert (row["top_to_median_plays_ratio"], row["share_of_plays_from_top_clip"], row["n_clips"]) == (7.0, 0.7, 4)
    two = stats.user_stats(spark.createDataFrame(clip_rows([5.0, 5.0], step=7 * 86400), CLIP)).first()
    assert (two["clip_time_span_days"], two["approx_clips_per_week"], two["log_plays_mad"]) == (7.0, 2.0, 0.0)


def test_robust_z(spark):
    rows = spark.createDataFrame(clip_rows([10.0, 100.0, 1e3, 1e4, 1e5]), CLIP)
    found = {r["clip_id"]: r["is_creator_low_outlier"] for r in stats.robust_z(rows, -1.0).collect()}
    assert found[0] is True and not any(found[k] for k in (2, 3, 4))
    same = stats.robust_z(spark.createDataFrame(clip_rows([5000.0] * 5), CLIP), -1.0).collect()
    assert all(r["creator_relative_robust_z"] == 0 for r in same)


def test_exact_quantiles(spark):
    random = np.random.default_rng(1)
    for values in ([1.0], [3.0, 3.0, 3.0], random.lognormal(3, 2, 997).tolist(), [0.0] * 500 + [1e9]):
        got = quantiles.exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", [0.0, 0.05, 0.5, 0.99, 1.0])
        assert np.allclose(got, np.quantile(values, [0.0, 0.05, 0.5, 0.99, 1.0]))
    assert quantiles.exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_filter_stage(spark):
    rows = clip_rows([2000.0, 3000.0, 4000.0, 5000.0, 6000.0]) + [(9, 1, None, None, None, None, None)]
    clips = spark.createDataFrame(rows, CLIP)
    settings = FilterSettings(min_median_plays=10, min_clips=1, low_percentile=0.0, high_percentile=1.0)
    flagged, users = eligibility(clips, settings)
    found = {r["clip_id"]: (r["is_preprocessed"], r["is_eligible"]) for r in flagged.collect()}
    assert found[9] == (False, False) and all(found[k] == (True, True) for k in range(5))
    assert users.first()["is_eligible"] is True
    assert hard_flags(clips, settings).where("is_preprocessed").count() == 5
    first = sorted(map(tuple, selection(clips, settings).collect()))
    more = clips.union(spark.createDataFrame(clip_rows([7000.0] * 3, user=2, first=100), CLIP))
    assert first == sorted(tuple(r) for r in selection(more, settings).where("user_id = 1").collect())


def test_empty_clips(spark):
    clips = spark.createDataFrame([], CLIP)
    flagged, users = eligibility(clips, FilterSettings())
    assert flagged.count() == users.count() == 0


def test_top_k(spark):
    rows = spark.createDataFrame([("c", "house", 0.5), ("c", "techno", 0.3), ("c", "house", 0.4), ("c", "pop", 0.2)], "k string, label string, score double")
    assert [(r["label"], round(r["weight"], 4)) for r in stats.label_topk(rows, ["k"], 3).orderBy("rk").collect()] == [("house", 1.0), ("techno", 0.3333), ("pop", 0.2222)]
    zero = stats.label_topk(rows.withColumn("score", F.lit(0.0)), ["k"], 3)
    assert {r["weight"] for r in zero.collect()} == {0.0}
    langs = spark.createDataFrame([("c", x) for x in ("en", "en", "es", "en", "es", "pt", "", None)], "k string, lang string")
    assert [(r["lang"], round(r["share"], 4)) for r in stats.top_shares(langs, ["k"], "lang", 2).orderBy("rk").collect()] == [("en", 0.5), ("es", 0.3333)]


def test_leave_one_out(spark):
    rows = [("c", m, v) for m, v in ((1, 1.0), (1, 3.0), (2, 4.0), (3, 6.0), (3, 5.0))]
    found = {r["m"]: r["z"] for r in stats.leave_one_out(spark.createDataFrame(rows, "c string, m long, v double"), "c", "m", "v").collect()}
    for m in (1, 2, 3):
        own, rest = [v for _, k, v in rows if k == m], [v for _, k, v in rows if k != m]
        assert math.isclose(found[m], (np.mean(own) - np.mean(rest)) / np.std(rest), rel_tol=1e-9)


def test_guards_differ(spark):
    rows, none = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([], "k long")
    assert relational.kept_by(rows, none, ["k"], empty_keeps_all=True).count() == 2
    assert relational.kept_by(rows, none, ["k"], empty_keeps_all=False).count() == 0


def test_ids_and_updates(spark):
    known = spark.createDataFrame([("b", 7)], "name string, id long")
    names = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("a",)], "name string")
    assert sorted(map(tuple, relational.allocate_ids(known, names, "name", "id").collect())) == [("a", 8), ("b", 7), ("c", 9)]
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    changed = relational.conditional_update(rows, spark.createDataFrame([(1, "z"), (2, None)], "k long, v string"), ["k"], ["v"])
    assert sorted(map(tuple, changed.collect())) == [(1, "z"), (2, "y")]


def test_overwrite_scope(spark, tmp_path):
    path = str(tmp_path / "t")
    relational.overwrite_scope(spark.createDataFrame([(1, "a"), (2, "b")], "k long, c string"), path, ["c"])
    relational.overwrite_scope(spark.createDataFrame([(3, "a")], "k long, c string"), path, ["c"])
    assert sorted((r["k"], r["c"]) for r in spark.read.parquet(path).collect()) == [(2, "b"), (3, "a")]


def test_round_robin(spark):
    rows = spark.createDataFrame([(1, 11, 1), (1, 12, 1), (1, 13, 1), (2, 21, 1), (2, 22, 1)], "member long, clip long, size long").withColumn("g", F.lit("g"))
    pick = lambda budget, total: [r["clip"] for r in relational.round_robin(rows, "g", [F.asc("member")], "member", [F.asc("clip")], F.col("size"), 2, total, budget).orderBy("pick_rank").collect()]
    assert pick(99, 99) == [11, 21, 12, 22] and pick(3, 99) == [11, 21, 12] and pick(99, 2) == [11, 21]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 1.0]), (1, [0.0, 0.0])], "u long, v array<float>")
    assert np.allclose(vectors.pooled_arrays(rows, ["u"], "v").first()["embedding"], [4 / 3, 4 / 3])
    back = rows.select(vectors.decode_vector(vectors.encode_vector(F.col("v"))).alias("w"), "v").collect()
    assert all(r["w"] == r["v"] for r in back)
    patches = spark.createDataFrame([([[[1.0], [2.0], [3.0], [5.0]]],)], "p array<array<array<double>>>")
    assert patches.select(vectors.patch_pool(F.col("p"))).first()[0] == [1.0, 2.0, 4.0]


def test_cluster_tables(spark):
    rows = [(0, c) for c in (0.9, 0.95, 0.4)] + [(1, 1.0)] * 2 + [(2, 0.5)] * 4 + [(-1, 0.0)] * 2
    frame = spark.createDataFrame(rows, "cluster_id long, centrality double")
    found = {r["cluster_id"]: (r["n_users"], round(r["high_conf_fraction"], 4)) for r in clusters.cluster_metrics(frame).collect()}
    assert found == {0: (3, 0.6667), 1: (2, 1.0), 2: (4, 0.0)}
    centres = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 2.0), (3, 3.0, 4.0)], "id long, x double, y double")
    near = clusters.nearest(centres.where("id = 0"), centres, F.col("id"), F.col("x"), F.col("y"), 2).orderBy("rk").collect()
    assert [(r["nearest_id"], r["distance"]) for r in near] == [(1, 1.0), (2, 2.0)]
    dots = spark.createDataFrame([(0, 0.0, 0.0), (1, 5.0, 5.0), (2, 5.2, 5.1)], "k long, x double, y double")
    probe = spark.createDataFrame([(9, 5.1, 5.05)], "k long, x double, y double")
    assert clusters.nearest_within(probe, dots, "k", "x", "y", 0.5).first()["nearest_id"] == 2
    shapes = spark.createDataFrame([(0, 0.0, 0.0, 5.0, 5.0, 0.0), (1, 0.0, 0.0, 1.0, 1.0, 0.0)], "cluster_id long, cx double, cy double, rx double, ry double, angle double")
    assert clusters.containing(dots.where("k = 0").select("x", "y"), shapes, "x", "y").first()["cluster_id"] == 1


def test_champion(spark):
    runs = spark.createDataFrame([(1, 0.90, 0.80), (2, 0.82, 0.79)], "run_id long, dbcv double, plateau double")
    assert clusters.champion(runs, 0.05).first()["run_id"] == 2
    assert clusters.champion(runs, 0.001).first()["run_id"] == 1


def test_density_clusters():
    random = np.random.default_rng(0)
    points = np.vstack([random.normal(c, 0.1, (40, 2)) for c in ((0, 0), (5, 5), (0, 5))] + [random.uniform(-10, 15, (6, 2))])
    found, strength = clusters.density_labels(points, 10)
    assert found.max() == 2 and all(len(set(found[k * 40 : k * 40 + 40]) - {-1}) == 1 for k in range(3))
    assert ((0 <= strength) & (strength <= 1)).all() and clusters.validity(points, found) > 0.5
    with pytest.raises(ValueError):
        clusters.density_labels(points[:5], 10)


def test_label_codes(spark):
    entry = "array<struct<tag:string,grounded_in:array<string>,confidence:string>>"
    schema = f"o {entry}, a {entry}, c {entry}, s string"
    good = [("soft window light", None, None), ("wooden desk", None, None), ("linen shirt", None, None)]
    tags = [("calm minimal mood", ["wooden desk"], "high"), ("slow living", ["linen shirt"], "low")]
    sentence = "A quiet room with soft light."
    rows = [(good, tags, tags, sentence), (good[:1], tags, tags, sentence), (good, [("x", ["sofa"], "sure")], tags + tags, "short")]
    frame = spark.createDataFrame(rows, schema)
    found = [r[0] for r in frame.select(labels.clip_codes(F.col("o"), F.col("a"), F.col("c"), F.col("s"), labels.LabelLimits())).collect()]
    assert found[0] == "" and "S1" in found[1] and found[2] == "S1,S2,S3,S4,S6,S7,S8"


def test_cluster_codes(spark):
    schema = "label string, rep array<struct<tag:string>>, aes array<struct<tag:string,grounded_in:array<string>>>, tools array<string>, sentences array<string>, conf array<string>, summary string"
    good = ("Warm Rooms", [("wooden desk",), ("soft light",)], [("calm mood", ["wooden desk"]), ("slow days", ["soft light"])], ["film grain"], ["x" * 30], ["high"], "y" * 200)
    bad = ("Z" * 41, [("a and b",)], [("q", ["nothing"])], [], ["x"], ["sure"], "y")
    frame = spark.createDataFrame([good, bad], schema)
    limits = labels.LabelLimits()
    soft = [r[0] for r in frame.select(labels.cluster_soft_codes(F.col("rep"), F.col("aes"), F.col("tools"), F.col("sentences"), F.col("conf"), F.col("summary"), limits)).collect()]
    assert soft == ["", "SC1,SC2,SC4,SC5,SC6,SC7,SC8,SC9"]
    tags = F.array(F.lit("plain tag"), F.lit("naïve tag"))
    assert [r[0] for r in frame.select(labels.cluster_hard_code(F.col("label"), tags, limits)).collect()] == ["HC6", "HC4"]


def test_json_repair():
    assert labels.repair_json("“a”") is None
    assert labels.repair_json('```json\n{"a ": [1, 2,]}\n```') == {"a": [1, 2]}
    assert labels.repair_json('{"a": {"b": "c') == {"a": {"b": "c"}}
    assert labels.repair_json("no") is None and labels.repair_json(None) is None
    assert labels.closest_keys(["cluster_labl", "x"], ["cluster_label", "summary"]) == {"cluster_labl": "cluster_label"}


def test_distinct_names(spark):
    rows = [("c", i, "Ambient Night", ["Ambient Rain", "Quiet Rain Hours", f"Word{i} Stone"]) for i in range(5)]
    names = [r["label"] for r in labels.distinct_names(spark.createDataFrame(rows, "embedding_case string, cluster_id long, label string, candidates array<string>")).collect()]
    assert len(set(names)) == 5 and sum("Ambient" in n for n in names) <= 2


def test_rarest_labels_come_first():
    uses = {"amber": 0, "brook": 1, "cedar": 2, "dune": 0}
    found = list(labels.rarest_labels(uses, 2))
    assert len(found) == len(set(found)) == 6 + 4
    cost = lambda t: (sum(uses[w.lower()] >= 2 for w in t.split()), sum(uses[w.lower()] for w in t.split()), len(t.split()))
    assert [cost(t) for t in found] == sorted(map(cost, found)) and found[0] == "Amber Dune"
    assert list(labels.rarest_labels({"one": 0}, 2)) == []
    # lazy: a pool of a thousand words has 166 million choices
    assert next(labels.rarest_labels({f"w{i}": 5 for i in range(1000)}, 2)) == "W0 W1"


def test_names_of_crowded_words(spark):
    rows = [("c", i, "Ambient Night", ["Ambient Night", f"rare{i} and the ambient"]) for i in range(6)] + [("d", i, None, ["x"]) for i in range(3)]
    frame = spark.createDataFrame(rows, "embedding_case string, cluster_id long, label string, candidates array<string>")
    found = {(r["embedding_case"], r["cluster_id"]): r["label"] for r in labels.distinct_names(frame).collect()}
    assert len(set(found.values())) == 9 and found["c", 0] == "Ambient Night"
    assert [found["d", i] for i in range(3)] == ["Unnamed", "Unnamed 2", "Unnamed 3"]


def test_repeated_points_and_wide_ellipses(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (1, 0.5, 0.5), (2, 900.0, 0.0), (3, 5000.0, 0.0)], "id long, px double, py double")
    ellipses = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, 0.0), (2, 0.0, 0.0, 1000.0, 1000.0, 0.0)], "cluster_id long, cx double, cy double, rx double, ry double, angle double")
    got = sorted((r["id"], r["cluster_id"]) for r in clusters.containing(points, ellipses, "px", "py").collect())
    assert got == [(1, 1), (1, 1), (2, 2)]
    assert clusters.containing(points, ellipses.limit(0), "px", "py").count() == 0


def test_nearest_of_many_centroids(spark):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(20)] + [(3, 3.0, 3.0)], "own long, px double, py double")
    centres = spark.createDataFrame([(i, i * 0.37 % 7, i * 0.91 % 5) for i in range(60)], "id long, x double, y double")
    args = (F.col("own"), F.col("px"), F.col("py"), 4)
    one, many = (sorted(map(tuple, clusters.nearest(rows, centres, *args, most=most).collect())) for most in (10_000, 7))
    assert one == many and len(one) == 21 * 4


def test_leave_one_out_of_large_values(spark):
    rows = [("a", i % 5, 1e9 + i) for i in range(40)]
    got = {r["m"]: r["z"] for r in stats.leave_one_out(spark.createDataFrame(rows, "c string, m int, v double"), "c", "m", "v").collect()}
    for m in range(5):
        own, rest = ([v for _, k, v in rows if (k == m) == mine] for mine in (True, False))
        expected = (statistics.fmean(own) - statistics.fmean(rest)) / statistics.pstdev(rest)
        assert abs(got[m] - expected) < 1e-6


def test_failure_message(spark):
    texts = ["plain", "it's", "a \"b\" it's", "line\nend", "x" * 6000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.failure_message(F.lit("H1"), F.col("t")).alias("m")).collect()
    for i, message in rows:
        raw = texts[i]
        shown = [part.replace("\n", "\\n") for part in (raw, raw[:1500], raw[-1500:])]
        assert message == (f"H1 len={len(raw)} body={shown[0]!r}" if len(raw) <= 5000 else f"H1 len={len(raw)} head={shown[1]!r} tail={shown[2]!r}")


def test_atomic_write_replaces(spark, tmp_path):
    for body in ("one", "two"):
        serving.write_atomically(body, str(tmp_path / "doc.json"), spark)
    assert (tmp_path / "doc.json").read_text() == "two\n" and not [p for p in tmp_path.iterdir() if p.name.endswith(".part")]


def test_serving_round_trip(spark):
    schema = "run_id string, user_id long, x double, tags array<struct<tag:string,n:int>>, langs array<string>"
    rows = [("r", 1, 1.5, [("b", 2), ("a", 1)], ["en", "fr"]), ("r", 2, None, [], None), ("s", 1, 0.0, None, [])]
    docs = spark.createDataFrame(rows, schema)
    back = serving.rebuild(serving.shred(docs, ["run_id", "user_id"]), ["run_id", "user_id"], docs.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))
    body = serving.canonical_json(docs, ["run_id", "user_id"]).where("run_id = 'r' AND user_id = 1").first()["body"]
    assert body == '{"langs":["en","fr"],"run_id":"r","tags":[{"n":2,"tag":"b"},{"n":1,"tag":"a"}],"user_id":1,"x":1.5}'
    assert serving.document(serving.shred(docs, ["run_id", "user_id"]), ["run_id", "user_id"], docs.columns, run_id="x").count() == 0


def test_offload(spark, tmp_path):
    docs = spark.createDataFrame([("r", 1, [1]), ("s", 1, [2])], "run_id string, user_id long, v array<int>")
    serving.offload(serving.shred(docs, ["run_id", "user_id"]), str(tmp_path), ["r", "s"])
    serving.offload(serving.shred(docs.where("run_id = 's'"), ["run_id", "user_id"]), str(tmp_path), ["s"])
    assert [r["run_id"] for r in spark.read.parquet(str(tmp_path / "document")).select("run_id").collect()] == ["s"]


def test_profiles(spark):
    rows = spark.createDataFrame([(i, float(i % 3), float(i), i % 2 if i < 6 else -1, None, 10.0, 100) for i in range(7)], "user_id long, x double, y double, cluster_id long, centrality double, median_plays double, follower_count long")
    users, shapes = profiles.layout(rows)
    assert users.count() == 7 and [r["label"] for r in shapes.orderBy("cluster_id").collect()] == ["Cluster 1", "Cluster 2"]
    clips = rows.select("user_id", (F.col("user_id") > 2).alias("is_happy"))
    profile = profiles.cluster_profile(rows, clips, ["is_happy"])
    assert profile.count() == 2 and {r["n"] for r in profiles.violations(profile, {"size": F.col("size") > 0}).collect()} == {0}
    assert profiles.creator_profile(rows, clips).count() == 6


def test_ledger(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "ledger"))
    mark = ledger.Fingerprint("a", "b", book.dependency_digest("none", "all"))
    assert book.diff("filter", "all", mark) == "no prior state" and not book.must_reset("filter", "all", mark)
    book.seal("filter", "all", mark)
    assert book.diff("filter", "all", mark) == ""
    other = ledger.Fingerprint("a2", "b2", mark.dependency_hash)
    assert book.diff("filter", "all", other) == "data+config" and book.must_reset("filter", "all", other)
    book.seal("filter", "all", other)
    assert book.diff("filter", "all", other) == "" and book.rows().count() == 1
    assert ledger.topological(ledger.DEPENDENCIES).index("clustering") < ledger.topological(ledger.DEPENDENCIES).index("labels")
    with pytest.raises(ValueError):
        ledger.topological({"a": ("b",), "b": ("a",)})


def test_incremental(spark):
    desired = spark.createDataFrame([(1, "h1", "t1"), (2, "new", "t2"), (3, "h3", "bad")], "k long, source_hash string, text string")
    stored = spark.createDataFrame([(1, "h1", "kept"), (2, "old", "v"), (9, "x", "orphan")], "k long, source_hash string, value string")
    compute = lambda rows: rows.select("k", F.when(F.col("text") != "bad", F.upper("text")).alias("value"), F.when(F.col("text") == "bad", "failed").alias("error"))
    rows, failed = ledger.incremental(desired, stored, "k", compute)
    assert sorted((r["k"], r["value"]) for r in rows.collect()) == [(1, "kept"), (2, "T2")] and [r["k"] for r in failed.collect()] == [3]


class Flaky:
    def embed(self, text):
        if text == "bad":
            raise ValueError("no")
        return [1.0]

    def embed_batch(self, texts):
        return [self.embed(t) for t in texts]

    def translate(self, texts, langs):
        return [t.upper() for t in texts]


def test_plugins(spark):
    rows = spark.createDataFrame([(1, "a", "fr"), (2, "bad", "en"), (3, " ", "de")], "k long, t string, l string")
    found = {r["k"]: (r["embedding"], r["error"]) for r in plugins.embedded(rows, "k", "t", Flaky).collect()}
    assert found[1] == ([1.0], None) and found[2] == (None, "no")
    assert [tuple(r) for r in plugins.translated(rows, "k", "t", "l", Flaky).collect()] == [(1, "A")]
    assert len(plugins.HashProvider(48).embed("x")) == 48


def test_readers(spark, tmp_path):
    (tmp_path / "seeds.csv").write_text("https://x.com/foo/\nbar\n foo \nhttps://x.com/\n")
    names = readers.seeds(readers.seed_file(spark, str(tmp_path / "seeds.csv")), "url")
    assert sorted(map(tuple, names.collect())) == [("bar", 1), ("foo", 2)]
    profile = '[{"id":1,"play_count":5,"caption":{"text":"c"}},{"id":2},{"id":3,"play_count":9}]'
    rows = readers.flattened(spark.createDataFrame([(7, profile)], "user_id long, media string"), "media", spark.createDataFrame([(2,)], "clip_id long"))
    assert [r["clip_id"] for r in rows.collect()] == [3, 1]
    (tmp_path / "media").mkdir()
    (tmp_path / "media" / "5.mp4").write_bytes(b"abc")
    files = readers.media_stats(spark, str(tmp_path / "media"))
    sizes = readers.with_media(spark.createDataFrame([(5,), (6,)], "clip_id long"), files)
    assert {r["clip_id"]: r["size"] for r in sizes.collect()} == {5: 3, 6: -1}
    clips = spark.createDataFrame([(1, None, "t", "v", False), (2, True, "t", "v", False), (3, False, None, "v", True), (4, None, None, None, False)], "clip_id long, is_downloaded boolean, thumbnail_url string, video_url string, has_image boolean").withColumn("has_video", F.lit(False))
    jobs = readers.download_jobs(clips)
    assert sorted((r["clip_id"], r["kind"]) for r in jobs.collect()) == [(1, "image"), (1, "video")]
    assert readers.download_jobs(clips, retry_failed=True).count() == 3
    done = readers.fetched(jobs, lambda url: b"x" * 500).collect()
    assert {(r["kind"], r["size"], r["error"]) for r in done} == {("image", 500, None), ("video", None, "too small")}
    lines = spark.createDataFrame([("# no",), (" thanks for watching ",), ("abc",), ("thanks for watching",)], "value string")
    assert [r[0] for r in readers.phrases(lines).collect()] == ["thanks for watching"]


def test_streaming(spark, tmp_path):
    from tidewell.streaming import incremental

    folder = str(tmp_path / "in")
    spark.createDataFrame([("a", "failure"), ("a", "failure"), ("b", "success")], "key string, outcome string").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("key string, outcome string").parquet(folder)
    run = incremental.retry_states(stream, 2).writeStream.outputMode("update").format("memory").queryName("states").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    assert sorted(map(tuple, spark.table("states").collect())) == [("a", "failed", 2), ("b", "success", 1)]
    batch = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k long, h string")
    assert [r["k"] for r in incremental.changed_rows(batch, spark.createDataFrame([(1, "x")], "k long, h string"), "k", "h").collect()] == [2]


def test_stages(spark, tmp_path):
    from tidewell.plans import stages

    calls, steps = [], stages.Stages()
    for name in ("labels", "filter", "clustering"):
        steps.add(name, lambda n=name: calls.append(n))
    steps.run()
    assert calls == ["filter", "clustering", "labels"]
    with pytest.raises(ZeroDivisionError), stages.stage("bad"):
        raise ZeroDivisionError
    failures = []
    with stages.item("one", failures):
        raise ValueError("x")
    assert failures == [("one", "x")]
    tries = iter([ValueError(), ValueError(), 5])

    def flaky():
        value = next(tries)
        if isinstance(value, Exception):
            raise value
        return value

    assert stages.retried(flaky, 3, sleep=lambda s: None) == 5
    assert stages.exposed({"a": True, "b": False}, ["a", "b", "c"]) == ["a"]
    state = spark.createDataFrame([(1, None, 0, None), (2, None, 0, None)], "k long, status string, attempts long, error string")
    rounds = stages.generation_rounds(state, "k", lambda rows, n: rows.select("k", F.when(F.col("k") == 1, "success").otherwise("failure").alias("outcome")), 3, 7, lambda f: spark.createDataFrame(f.collect(), f.schema))
    assert {r["k"]: (r["status"], r["attempts"]) for r in rounds.collect()} == {1: ("success", 1), 2: ("failed", 3)}


def test_media(spark, tmp_path):
    import wave

    from tidewell.sources import media

    for name, rate in (("1", 16000), ("2", 8000)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as sound:
            sound.setnchannels(1)
            sound.setsampwidth(2)
            sound.setframerate(rate)
            sound.writeframes(b"\x00\x40" * rate)
    (tmp_path / "3.wav").write_bytes(b"none")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    probed = media.probed(files).withColumn("media_id", F.regexp_extract("path", "([0-9]+)[.]wav$", 1).cast("long"))
    found = {r["media_id"]: (r["rate"], r["seconds"]) for r in probed.collect()}
    assert found == {1: (16000, 1.0), 2: (8000, 1.0), 3: (None, None)}
    samples = {r["path"][-5]: r["samples"] for r in media.decoded(files).collect()}
    assert samples["1"][0] == 0.5 and samples["3"] is None
    selected = spark.createDataFrame([(1,), (2,), (3,)], "clip_id long")
    swept = media.audio_to_sweep(probed, selected)
    assert [r["path"][-5] for r in swept.collect()] == ["2"] and media.delete_files(swept) == 1
    stats_of = readers.media_stats(spark, str(tmp_path))
    assert media.to_transcode(stats_of, stats_of).count() == 0 and media.to_transcode(stats_of, stats_of.limit(0)).count() == 2


def test_schemas(spark):
    from tidewell import schemas

    rows = schemas.conform(spark.createDataFrame([(1, "x")], "id long, other string"), "users")
    assert rows.schema == schemas.schema("users") and rows.first()["is_selected"] is None
    body = '{"cluster_label":"A B","tool_tags":["t"],"visual_repertoire":[{"tag":"x"}]}'
    frame = spark.createDataFrame([(body, "success"), (body, "failed")], "p string, status string").withColumn("p", F.from_json("p", schemas.cluster_label()))
    blocks = [r[0] for r in frame.select(labels.label_block(F.col("p"), "visual_repertoire", "visual", F.col("status"))).collect()]
    assert blocks[0]["repertoire"][0]["tag"] == "x" and blocks[1] is None


def test_rendering(spark, tmp_path):
    rows = spark.createDataFrame([("c", 2, 20, "b"), ("c", 1, 10, "a")], "k string, pick_rank long, clip_id long, payload string")
    assert labels.candidates_body(rows, ["k"], ["pick_rank"]).first()["body"] == '[{"clip_id":10,"payload":"a"},{"clip_id":20,"payload":"b"}]'
    names = spark.createDataFrame([("c", 1, "B", ["x", "y"]), ("c", 0, "A", [])], "embedding_case string, cluster_id long, label string, candidates array<string>")
    assert labels.roster(names).first()["body"] == "0: A []\n1: B [x; y]"
    serving.write_atomically("{}", str(tmp_path / "m.json"), spark)
    assert (tmp_path / "m.json").read_text() == "{}\n"


def test_numbered(spark):
    from pyspark.sql import Window

    from tidewell.operators.ranking import numbered

    random = np.random.default_rng(3)
    rows = [(int(random.integers(3)), i, None if i % 17 == 0 else float(random.choice([0.0, -5.0, 2.5, random.lognormal(5, 3)]))) for i in range(600)] + [(None, 601, 1.0), (9, 602, None)]
    frame = spark.createDataFrame(rows, "k long, id long, v double")
    for down in (False, True):
        order = F.desc_nulls_last("v") if down else F.asc_nulls_last("v")
        expected = frame.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(order, "id")).cast("long")).withColumn("m", F.rank().over(Window.partitionBy("k").orderBy(order)).cast("long"))
        got = numbered(numbered(frame, ["k"], "v", [F.asc("id")], "n", down), ["k"], "v", None, "m", down)
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert numbered(frame.limit(0), ["k"], "v", None, "n").count() == 0


PAGES = {None: ("first", "a"), "a": ("second", None)}


def pages(name, cursor):
    body, following = PAGES[cursor]
    return f"{name} {body}", following


def test_paged_profiles(spark):
    spark.dataSource.register(readers.PagedProfiles)
    found = spark.read.format("paged_profiles").option("names", "x,y").option("client", "tests.test_operators:pages").load()
    assert sorted(map(tuple, found.collect())) == [("x", 0, "x first"), ("x", 1, "x second"), ("y", 0, "y first"), ("y", 1, "y second")]
    one = spark.read.format("paged_profiles").option("names", "x").option("client", "tests.test_operators:pages").option("max_pages", "1").load()
    assert one.count() == 1


def test_parsed_names(spark):
    frame = spark.createDataFrame([('[{"cluster_id":1,"label":"A B"}]',), ('{"labels":[{"cluster_id":2,"label":"C D"}]}',), ("no",)], "r string")
    assert [[tuple(x) for x in r[0] or []] for r in frame.select(labels.parsed_names(F.col("r"))).collect()] == [[(1, "A B")], [(2, "C D")], []]
    segments = spark.createDataFrame([([(0.0, 1.5), (2.0, 2.25)],), ([],)], "s array<struct<start:double,end:double>>")
    assert [r[0] for r in segments.select(plugins.speech_seconds(F.col("s"))).collect()] == [1.75, 0.0]


def test_reduce(spark):
    rows = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(10)], "k long, v array<double>")
    reduced = clusters.reduce_dimensions(rows, "k", "v", 1).orderBy("k").collect()
    steps = np.diff([r["reduced"][0] for r in reduced])
    assert np.allclose(np.abs(steps), np.sqrt(5))


def test_windowed_counts(spark, tmp_path):
    from tidewell.streaming import incremental

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    run = incremental.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("daily").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    assert spark.table("daily").agg(F.sum("n")).first()[0] == source.count()


def test_dirty_transcripts_follow_their_sql(spark, tmp_path):
    import duckdb

    from tidewell.plans import catalogue

    rows = [(1, 1, "again again again again again, and more"), (1, 2, "Plain words here."), (2, 1, "ab"), (2, 5, "Plain words here."), (3, 1, None)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    expected = sorted(duck.execute(catalogue.ORACLE_SQL["dirty_transcripts"]).fetchall())
    assert sorted(tuple(r) for r in catalogue.dirty_transcripts(spark, str(tmp_path)).collect()) == expected
    assert spark.sql("SELECT 'again again again again again' AS t").select(text.dirty_transcript(F.col("t"), F.lit(0.0), F.lit(0.0), F.lit(False))).first()[0]


def test_dirty_transcripts_apply_every_rule(spark, tmp_path):
    import duckdb

    from tidewell.plans import catalogue

    plain = "Plain words here"
    dirty = ["so it went on, on On ... on on and on", "ΟΔΟΣ, οδος, ΟΔΟΣ, οδος, ΟΔΟΣ and more", "word x² x² x² x² x² word", "  Thanks for\n WATCHING! ", "\xa0Thank you very much.\u2003", "(music) Thanks for watching,  and I'll see you next time. See you!", plain + " by DimaTorzok, 2020", "THANKS FOR WATCHING.", "thank you, Mr. President, " * 26]
    clean = [plain, "on and on and on and on and on", "one on, on, on, on, onward", "Well, thank you very much, they said.", "Thanks for watchinġ.", "THANKS FOR WATCHİNG."]
    rows = [(i, 1, t) for i, t in enumerate(dirty + clean)] + [(0, 1, plain)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    expected = sorted((i, turn, t in dirty) for i, turn, t in rows)
    assert sorted(tuple(r) for r in catalogue.dirty_transcripts(spark, str(tmp_path)).collect()) == expected
    assert sorted(duck.execute(catalogue.ORACLE_SQL["dirty_transcripts"]).fetchall()) == expected
