"""The pipeline's near-dedup stage against all pairs by brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import minhash, simhash, similar, textkit


def test_near_dedup_stage_finds_similar_texts(spark):
    random.seed(11)
    docs, common = [], " ".join(f"c{i}" for i in range(40))
    for _ in range(60):
        words = [f"w{random.randrange(900)}" for _ in range(random.randrange(3, 150))]
        docs.append(" ".join(words) + random.choice(["", " " + common]))
        for _ in range(random.randrange(4)):
            near = list(words)
            near[random.randrange(len(near))] = "changed"
            docs.append(" ".join(near))
    docs += ["", None, " \n", common, common.upper()]
    sets = [frozenset(x for part in simhash.shingle_hashes((t or "").encode(), 5) for x in part) for t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] == sets[j] or 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, "").collect()) == sorted(set(root))
    assert len(set(root)) < simhash.representatives(frame).count()


def test_bands_and_sketches_keep_similar_sets():
    random.seed(12)
    missed = 0
    for _ in range(400):
        n = random.choice([5, 9, 20, 60, 300, 2000])
        words = [random.getrandbits(64) for _ in range(2 * n)]
        apart = n // 9
        a, b = (np.array(words[: n - apart] + words[k * n : k * n + apart], np.uint64) for k in (1, 1))
        b[n - apart :] = np.array([random.getrandbits(64) for _ in range(apart)], np.uint64)
        assert 9 * (n - apart) >= 4 * 2 * n
        _, _, keys, sketches = similar.described([a, b])
        missed += not (keys[0] == keys[1]).any() or minhash.likeness(sketches[:1], sketches[1:])[0] < similar.LEAST_LIKENESS
    assert missed <= 1


def test_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_BYTES", 4096)
    random.seed(14)
    base = [f"v{i}" for i in range(200)]
    docs = [(i, " ".join(base[: 190 - i % 40] + [f"own{i}"])) for i in range(120)]
    docs += [(200 + i, " ".join(random.sample(base, 60))) for i in range(40)] + [(7, docs[7][1]), (None, docs[8][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    sets = [frozenset(x for part in simhash.shingle_hashes(t.encode(), 5) for x in part) for _, t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    assert similar.representatives(frame).count() == len(set(root))
    assert similar.representatives(frame.limit(0)).count() == 0


def test_exploded_bands_are_not_broadcast(spark):
    sets = textkit.written(spark.range(300).select("id", F.array(F.pmod("id", F.lit(7)), F.lit(-1)).alias("bands")))
    members = similar._apart(sets.select("id", F.explode("bands").alias("key")).withColumn("root", F.col("id")))
    assert "Broadcast" not in members._jdf.queryExecution().executedPlan().toString()
    assert members.count() == 600
