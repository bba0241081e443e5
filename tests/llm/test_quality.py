"""Statistics and classifiers against brute force and held-out labels."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidewell.llm import bytenet, queries, rules, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 5))
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered)


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_rules_query(spark):
    docs = {d["doc_id"]: d["text"] for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {d["doc_id"]: d["quality"] for d in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = {r["doc_id"]: r for r in queries.op9_quality_rules(spark, SF).collect()}
    assert rows.keys() == docs.keys()
    for i, text in docs.items():
        expected = statistics(text)
        assert tuple(rows[i][c] for c in STATS) == expected
        assert rows[i]["base_failed"] == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert not (rows[i]["kept"] and rows[i]["base_failed"])
    clean = [rows[i]["kept"] for i, q in labels.items() if q == 1 and not rows[i]["base_failed"]]
    assert np.mean(clean) > 0.97


def test_statistics_edges(spark):
    texts = [None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "x " * 400, "# $\n# $\n\n\n", "é𝔘|x\x1f\xa0y", "w " + "long " * 20_000]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for row in rules.statistics(frame).collect():
        assert tuple(row[c] for c in STATS) == statistics(texts[row["doc_id"]]), texts[row["doc_id"]]
    assert rules.statistics(frame.limit(0)).count() == 0
    kept = rules.kept_rows(frame, rules.DecisionList())
    assert kept.columns == frame.columns and kept.count() == 0


def test_decision_list(spark):
    random = np.random.default_rng(0)
    rows = []
    for _ in range(900):
        row = {"n_words": float(random.integers(10, 500)), "mean_word_chars": float(random.normal(5, 1)), "symbols_per_word": float(random.exponential(0.02)), "dup_lines": 0.0, "repeated_share": 0.0}
        row["bad"] = bool(random.random() < 0.3)
        if row["bad"]:
            row["symbols_per_word"] += 0.5 if random.random() < 0.5 else 0
            row["mean_word_chars"] += 0 if row["symbols_per_word"] > 0.5 else 9
        rows.append(row)
    found = rules.learn(rows)
    assert np.mean([found.keeps(r) != r["bad"] for r in rows]) > 0.97
    stats = [(i, int(r["n_words"]), int(r["n_words"] * r["mean_word_chars"]), int(r["n_words"] * r["symbols_per_word"]), 0, 0) for i, r in enumerate(rows)]
    frame = spark.createDataFrame(stats, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    verdicts = {r["doc_id"]: r["v"] for r in frame.select("doc_id", found.verdict().alias("v")).collect()}
    for i, words, chars, symbols, *_ in stats:
        assert verdicts[i] == found.keeps({"n_words": float(words), "mean_word_chars": chars / words, "symbols_per_word": symbols / words, "dup_lines": 0.0, "repeated_share": 0.0})
    assert rules.learn([]).rules == [] and rules.learn([r | {"bad": False} for r in rows]).rules == []


def test_rules_plan_is_native(spark):
    plan = rules.judged(spark.read.parquet(f"{SF}/documents.parquet"), rules.DecisionList())._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_network_held_out(spark):
    docs = {d["doc_id"]: d["text"] for d in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").collect()}
    labels = {d["doc_id"]: d["quality"] for d in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet").collect()}
    rows = {r["doc_id"]: r for r in queries.op2_quality_classifier(spark, SF.replace("0.001", "0.01")).collect()}
    assert rows.keys() == docs.keys()
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    assert all(r["held_out"] == held[i] and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in rows.items())
    test = [i for i in labels if held[i]]
    good, bad = (np.array([rows[i]["score"] for i in test if labels[i] == q]) for q in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.85
    alike = {}
    for i, text in docs.items():
        alike.setdefault(text, set()).add(rows[i]["score"])
    assert max(max(v) - min(v) for v in alike.values()) < 1e-9


def brute_score(net, text):
    """Window by window."""
    data = text.encode()
    blocks = -(-(len(data) + bytenet.WIDTH) // bytenet.BLOCK)
    data = np.frombuffer(data.ljust(blocks * bytenet.BLOCK, b"\0"), np.uint8)
    maxima = []
    for chunk in range(max(1, blocks - 1)):
        part = data[chunk * bytenet.BLOCK : (chunk + 2) * bytenet.BLOCK]
        last = chunk * bytenet.BLOCK + len(part) == len(data)
        places = range(len(part) if not last else len(part) - bytenet.WIDTH + 1)
        windows = [data[chunk * bytenet.BLOCK + p : chunk * bytenet.BLOCK + p + bytenet.WIDTH] for p in places]
        maxima.append(np.maximum(np.max([sum(net.vectors[b] @ net.filters[k] for k, b in enumerate(w)) for w in windows], axis=0) + net.bias, 0))
    return 1 / (1 + np.exp(-(np.mean(maxima, axis=0) @ net.weights + net.offset)))


def test_network_covers_whole_texts():
    texts = ["", "short", "x" * 121, "y" * 122, "z" * 128, "ab!" * 300, "clean " * 100 + "###"]
    net = bytenet.train([t.encode() for t in texts], [1, 0, 1, 0, 1, 0, 1], epochs=2)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    assert np.allclose(bytenet.scores(net, net.tables(), data, offsets), [brute_score(net, t) for t in texts], atol=1e-4)


def test_network_slopes():
    """One step of training lowers the loss, and a byte more at the start leaves patterns where filters meet them."""
    texts = [b"clean words of text " * (1 + i % 30) if i % 2 else b"## $$ junk " * (1 + i % 40) for i in range(60)]
    labels = [i % 2 for i in range(60)]
    net = bytenet.train(texts, labels, epochs=6)
    offsets = lambda rows: np.cumsum([0] + [len(t) for t in rows])
    score = lambda rows: bytenet.scores(net, net.tables(), np.frombuffer(b"".join(rows), np.uint8), offsets(rows))
    assert ((score(texts) > 0.5) == np.array(labels)).mean() > 0.95
    assert ((score([b"x" + t for t in texts]) > 0.5) == np.array(labels)).mean() > 0.95


def test_network_without_labels(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (2, "x", 0.2)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    for labels, expected in ((none, 0.5), (spark.createDataFrame([(1, 1), (2, 1), (None, 0), (2, None)], "doc_id long, quality int"), 1.0)):
        net = bytenet.fit(docs, labels)
        assert {r[0] for r in docs.select(bytenet.score(net, docs["text"])).collect()} == {expected}
        assert docs.limit(0).select(bytenet.score(net, docs["text"])).count() == 0


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urls.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len) if fits else None


def test_url_query(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").select("page_id", "url").collect()}
    rows = queries.op3_url_filter(spark, SF.replace("0.001", "0.01")).collect()
    assert {r["page_id"] for r in rows} == pages.keys()
    right = []
    for r in rows:
        assert (r["host"], r["path"], r["rule"]) == brute_rule(pages[r["page_id"]])
        if r["rule"]:
            assert r["verdict"] == urls.RULES[r["rule"]]
        else:
            right.append((r["verdict"] == "block") == bool(set(r["host"].split(".")) & set(urls.UNWANTED_HOSTS)))
    assert np.mean(right) > 0.9


def brute_features(url, suffixes, usual):
    host, path, _ = brute_rule(url)
    url = url or ""
    shares = [host.count(c) / len(host) for c in set(host)]
    query = url.partition("#")[0].partition("?")[2]
    suffix = host.rpartition(".")[2]
    inner = path.strip("/")
    return [len(url), len(host), len(path), inner.count("/") + bool(inner), host.count(".") + bool(host), sum(c in "0123456789" for c in url) / max(1, len(url)), host.count("-") / max(1, len(host)), -sum(p * np.log2(p) for p in shares), query.count("&") + bool(query), len(suffix), suffixes.get(suffix, usual)]


def test_url_features(spark):
    given = ["http://a-b.Example.org/x//y/?p=1&q=2#f?z=1", "https://x.y.com", "https://x.y.com/#a?b", None, "", "n.o/1", "http://localhost:80/a/b/c?&", "http://é.de/1/\n?x=1"]
    frame = spark.createDataFrame([(u,) for u in given], "url string").select("url", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))
    suffixes = {"org": 0.25, "": 0.75}
    rows = frame.select("url", urls.features(F.col("url"), F.col("host"), F.col("path"), suffixes, 0.5).alias("x")).collect()
    for row in rows:
        assert np.allclose(row["x"], brute_features(row["url"], suffixes, 0.5)), row["url"]


def test_hosts_that_were_not_trained_on(spark):
    """Labels come as a table; half of the unwanted and half of the other hosts are kept from training."""
    pages = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").select("page_id", "url")
    labelled = urls.labelled_by_host(pages).where("url IS NOT NULL")
    unseen = (F.crc32(F.regexp_extract(urls.host(F.col("url")), "([^.]+)\\.[^.]+\\.[^.]+$", 1).cast("binary")) % 2 == 0) & F.lit(True)
    forest = urls.fit(labelled.where(~unseen))
    rest = labelled.where(unseen).select("blocked", urls.features(F.col("url"), urls.host(F.col("url")), urls.path(F.col("url")), forest.suffixes, forest.usual).alias("x")).collect()
    x, y = np.array([r["x"] for r in rest]), np.array([r["blocked"] for r in rest])
    right = (forest(x) >= 0.5) == y
    print("unseen hosts:", len(y), "urls, blocked", y.sum(), "right of blocked", right[y == 1].mean(), "of others", right[y == 0].mean())
    assert y.sum() > 5 and right[y == 1].mean() > 0.5 and right[y == 0].mean() > 0.9


def test_labels_from_a_table(spark, tmp_path):
    path = str(tmp_path / "labels")
    spark.createDataFrame([(f"http://a{i}.net/x", 1) for i in range(5)], "url string, blocked int").write.parquet(path)
    spark.conf.set(queries.URL_LABELS, path)
    try:
        assert {r["verdict"] for r in queries.op3_url_filter(spark, SF).where("rule IS NULL").collect()} == {"block"}
    finally:
        spark.conf.unset(queries.URL_LABELS)


def test_url_edges(spark):
    given = [None, "", "nourl", "http://A.Example.ORG/ES/x", "x://y://z/a?b#c", "http://example.org/es/", "http://notexample.org", "HTTP://q.com/de/\n?x", "http://org/", "//x.org/", "http://\n.org/a", "http://İ.org/" + "p" * 5000]
    frame = spark.createDataFrame([(i % 11, u, "x") for i, u in enumerate(given)], "page_id long, url string, host string")
    rows = urls.judged(frame, spark.createDataFrame([], "url string, blocked int")).collect()
    expected = sorted(((i % 11, *brute_rule(u)) for i, u in enumerate(given)), key=str)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in rows), key=str) == expected
    assert {r["verdict"] for r in rows if r["rule"] is None} == {"allow"}
    assert urls.judged(frame.limit(0), urls.labelled_by_host(frame.limit(0))).count() == 0


def test_trees_learn():
    random = np.random.default_rng(1)
    x = random.uniform(size=(800, len(urls.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    forest = urls.boost(x[:500], y[:500])
    assert ((forest(x[500:]) > 0.5) == y[500:]).mean() > 0.95
    assert urls.boost(np.zeros((0, 2)), np.zeros(0))(np.zeros((1, 2)))[0] == pytest.approx(0.001)
