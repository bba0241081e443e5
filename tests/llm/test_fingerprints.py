"""MinHash and SimHash against exact shingle sets and brute-force links."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF
from tidewell.llm import components, minhash, queries, simhash, textkit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width=5):
    words = WORD.findall(text)
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def resemblance(a, b):
    return len(a & b) / len(a | b)


def expected_minhash(docs):
    docs = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))
    for i, (doc_id, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1] or ""
        text = text or ""
        third = len(text) // 3
        yield doc_id, text, text[: len(text) - third] + following[:third], following


def test_minhash_query(spark):
    rows = {r["doc_id"]: r for r in queries.op1_minhash_fingerprints(spark, SF).collect()}
    docs = [(d["doc_id"], d["text"]) for d in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    near, far = [], []
    for doc_id, text, changed, following in expected_minhash(docs):
        row = rows[doc_id]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        near.append(abs(row["near_edited"] - resemblance(shingles(text), shingles(changed))))
        far.append(abs(row["near_next"] - resemblance(shingles(text), shingles(following))))
    assert np.mean(near) < 0.04 and np.mean(far) < 0.03
    alike = {}
    for doc_id, text in docs:
        alike.setdefault(text, set()).add(rows[doc_id]["fingerprint"])
    assert all(len(v) == 1 for v in alike.values())


def test_minhash_edges(spark):
    docs = [(5, None), (4, ""), (3, "one two"), (3, "one two"), (2, "é" * 5000), (None, "last text of all words here"), (1, "x " * 3000)]
    frame = spark.createDataFrame([(i, t, "a", "b") for i, t in docs], "doc_id long, text string, fingerprint string, section string")
    rows = minhash.against_next(frame, section_rows=2).collect()
    assert len(rows) == len(docs)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[5]["near_next"] == 1.0 and by_id[5]["fingerprint"] == by_id[4]["fingerprint"]
    for doc_id, text, changed, _ in expected_minhash(docs):
        if doc_id != 3:
            assert by_id[doc_id]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
    lone = minhash.against_next(frame.limit(1)).collect()
    assert len(lone) == 1 and lone[0]["near_edited"] == 1.0
    assert minhash.against_next(frame.limit(0)).count() == 0


def test_likeness_is_unbiased():
    random.seed(5)
    words = [f"w{i}" for i in range(4000)]
    errors = []
    for share in (0.0, 0.2, 0.5, 0.8, 1.0):
        for _ in range(20):
            a = [random.choice(words) for _ in range(600)]
            b = [w if random.random() < share else random.choice(words) for w in a[:300]] + a[300:] if share else [random.choice(words) for _ in a]
            f = minhash.fingerprints([" ".join(a).encode(), " ".join(b).encode()])
            errors.append(minhash.likeness(f[:1], f[1:])[0] - resemblance(shingles(" ".join(a)), shingles(" ".join(b))))
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.12


def brute_simhash(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    parent = {f: f for f in set(prints.values())}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    distinct = sorted(parent)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for doc_id, f in prints.items():
        least[find(f)] = min(least.get(find(f), doc_id), doc_id)
    return {doc_id: least[find(f)] for doc_id, f in prints.items()}


def test_simhash_query(spark):
    docs = {d["doc_id"]: d["text"] for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: brute_simhash(t) for i, t in docs.items()}
    expected = {i: (f"{prints[i]:016x}", c) for i, c in classes(prints).items()}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op6_simhash_near_dedup(spark, SF).collect()} == expected


def test_links_are_complete(spark):
    random.seed(2)
    prints = set()
    for _ in range(40):
        base = random.getrandbits(64)
        for _ in range(12):
            changed = base
            for _ in range(random.randrange(4)):
                changed ^= 1 << random.randrange(64)
            prints.add(changed)
    signed = {f - 2**64 if f >= 2**63 else f: f for f in prints}
    frame = spark.createDataFrame([(f,) for f in signed], "fingerprint long")
    ordered = sorted(prints)
    expected = {(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if (a ^ b).bit_count() <= 2}
    for crowd in (simhash.CROWD, 3, 0):
        found = [tuple(sorted((signed[r["a"]], signed[r["b"]]))) for r in simhash.links(frame, crowd).collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(-5, 200)]
    found = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(1, 41)) and all(found[i] == 100 for i in range(101, 160)) and found[200] == -5
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_edges(spark):
    long = " ".join(f"word{i % 700}" for i in range(20_000))
    docs = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a B"), (6, long), (7, long), (None, "a b"), (7, long)]
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, fingerprint int")
    rows = sorted([(r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(frame).collect()])
    assert rows == [(0, 4), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6), (7, 6)]
    kept = simhash.representatives(frame)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 6]
    twice = simhash.representatives(frame.where("doc_id = 7"))
    assert twice.count() == 1
    assert simhash.near_duplicates(frame.limit(0)).count() == simhash.representatives(frame.limit(0)).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    random.seed(8)
    texts = [" ".join(random.choice(["one", "Two", "trois\n", "é", "\t4"]) + str(random.randrange(50)) for _ in range(n)) for n in (1, 3, 4, 200, 5000)] + ["x" * 3000, "", " a " * 900]
    whole = minhash.fingerprints([t.encode() for t in texts])
    prints = [simhash.fingerprint_of(t.encode()) for t in texts]
    assert prints == [brute_simhash(t) for t in texts]
    cut = lambda text: textkit.pieces(text, 64)
    monkeypatch.setattr(minhash, "pieces", cut)
    monkeypatch.setattr(simhash, "pieces", cut)
    monkeypatch.setattr(minhash, "GROUP_BYTES", 0)
    assert (minhash.fingerprints([t.encode() for t in texts]) == whole).all()
    assert [simhash.fingerprint_of(t.encode()) for t in texts] == prints


def test_exploded_keys_are_not_broadcast(spark, monkeypatch):
    frames = []
    monkeypatch.setattr(simhash, "written", lambda frame: frames.append(frame) or textkit.written(frame))
    prints = textkit.written(spark.range(300).select(F.pmod("id", F.lit(200)).alias("fingerprint")).distinct())
    for crowd in (1024, 4):
        frames.append(simhash.links(prints, crowd))
    assert len(frames) == 6
    assert not any("Broadcast" in frame._jdf.queryExecution().executedPlan().toString() for frame in frames)
