"""URL filters (operator 3): longest-match rules, and gradient-boosted trees on lexical features for the rest.

Rules come first. A rule has a host and a path; it fits that host and all its subdomains if the url's path
starts with its path, and the longest fitting rule's verdict holds.

Urls that no rule fits are judged by boosted regression trees with the logistic loss, trained from a table of labelled
urls. Features: lengths of url, host and path, depth, labels of the host, digit and hyphen ratios, character entropy of the
host, parameter count, and statistics of the suffix (its length and the share of blocked urls among the labelled
ones that have it). They are built-in expressions; only the trees run in Python, on arrays of numbers, and only for
urls that no rule decides.

Nulls: a null url, or one without ://, has empty host and path; no rule fits it, and the trees judge the empty url.
Repeated rows are judged alike. Only the named id and url are read. Without labels of both kinds every url that
no rule fits gets the verdict allow, or block if all labels say so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.rules import let
from tidewell.llm.textkit import written

# The rules, with the longest match's verdict.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}

# A fixture, for tables without labelled urls: labels of hosts that are unwanted.
UNWANTED_HOSTS = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")

SAMPLE_ROWS = 4000

#: Suffixes with a statistic of their own, the commonest ones.
MOST_SUFFIXES = 200

FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "hyphens", "entropy", "parameters", "suffix_length", "suffix_blocked")


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, null if none does. Of two equally long ones the smaller string counts."""
    fits = []
    for name in sorted(rules, key=lambda r: (-len(r), r)):
        domain, _, rest = name.partition("/")
        same = (host == domain) | host.endswith("." + domain)
        fits.append((same & path.startswith("/" + rest), name))
    if not fits:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(condition, F.lit(name)) for condition, name in fits])


def entropy(text: Column) -> Column:
    """Bits a character; 0 for an empty text."""
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text)
    bits = F.transform(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), lambda c: let(share(c), lambda p: -p * F.log2(p)))
    return F.aggregate(bits, F.lit(0.0), lambda total, x: total + x)


def suffix(host: Column) -> Column:
    """What follows the host's last dot; all of it without one."""
    return F.substring_index(host, ".", -1)


def features(url: Column, host: Column, path: Column, suffixes: dict[str, float], usual: float) -> Column:
    """An array of FEATURES; suffixes has the share of blocked urls for some, ``usual`` is that of the others."""
    url = F.coalesce(url, F.lit(""))
    ratio = lambda count, text: count / F.greatest(F.length(text), F.lit(1))
    many = lambda text, mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    inner = F.regexp_replace(path, r"^/+|/+\z", "")
    query = F.regexp_extract(F.substring_index(url, "#", 1), r"(?s)\?(.*)$", 1)
    last = suffix(host)
    blocked = F.lit(usual)
    if suffixes:
        known = F.create_map(*[F.lit(x) for pair in sorted(suffixes.items()) for x in pair])
        blocked = F.coalesce(F.try_element_at(known, last), F.lit(usual))
    values = (
        F.length(url),
        F.length(host),
        F.length(path),
        F.when(inner == "", 0).otherwise(many(inner, "/") + 1),
        F.when(host == "", 0).otherwise(many(host, ".") + 1),
        ratio(F.length(url) - F.length(F.translate(url, "0123456789", "")), url),
        ratio(many(host, "-"), host),
        entropy(host),
        F.when(query == "", 0).otherwise(many(query, "&") + 1),
        F.length(last),
        blocked,
    )
    return F.array(*[v.cast("double") for v in values])


@dataclass
class Forest:
    """Trees as arrays: feature, threshold, left child; the right child follows the left one, leaves have feature -1."""

    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    suffixes: dict[str, float] = field(default_factory=dict)
    usual: float = 0.5

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Probability of block."""
        total = np.full(len(x), self.start)
        for feature, threshold, left, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                node = at[rows]
                at[rows] = left[node] + (x[rows, feature[node]] > threshold[node])
            total += value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, depth: int, least: int = 5, decay: float = 1.0) -> tuple[np.ndarray, ...]:
    """One tree: splits that lower the second-order loss most, over all thresholds of all features."""
    feature, threshold, left, value = [-1], [0.0], [0], [0.0]
    queue = [(0, np.arange(len(x)), depth)]
    while queue:
        node, rows, more = queue.pop()
        g, h = slope[rows].sum(), curve[rows].sum()
        value[node] = -g / (h + decay)
        best = (1e-6, -1, 0.0)
        for f in range(x.shape[1]) if more and len(rows) >= 2 * least else ():
            order = rows[np.argsort(x[rows, f], kind="stable")]
            values = x[order, f]
            gl, hl = np.cumsum(slope[order])[:-1], np.cumsum(curve[order])[:-1]
            gain = gl**2 / (hl + decay) + (g - gl) ** 2 / (h - hl + decay) - g**2 / (h + decay)
            gain[values[1:] == values[:-1]] = 0
            gain[: least - 1] = gain[len(gain) - least + 1 :] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, (values[k] + values[k + 1]) / 2)
        if best[1] >= 0:
            feature[node], threshold[node], left[node] = best[1], best[2], len(feature)
            side = x[rows, best[1]] > best[2]
            for part in (rows[~side], rows[side]):
                queue.append((len(feature), part, more - 1))
                for column, empty in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
                    column.append(empty)
    return np.array(feature), np.array(threshold), np.array(left), np.array(value)


def boost(x: np.ndarray, blocked: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.3) -> Forest:
    """A forest for the logistic loss; blocked has 0 and 1."""
    share = float(np.clip(blocked.mean() if len(blocked) else 0.0, 0.001, 0.999))
    out = Forest(float(np.log(share / (1 - share))))
    if len(set(blocked.tolist())) < 2:
        return out
    total = np.full(len(x), out.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        tree = grow(x, p - blocked, p * (1 - p), depth)
        one = Forest(0.0, [(*tree[:3], rate * tree[3])])
        out.trees += one.trees
        q = one(x)
        total += np.log(q / (1 - q))
    return out


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """labelled: url, blocked (0 or 1). At most ``sample_rows`` distinct urls, by the smallest hashes."""
    marked = labelled.where("url IS NOT NULL AND blocked IN (0, 1)").groupBy("url").agg(F.max("blocked").alias("blocked"))
    sample = marked.orderBy(F.xxhash64("url"), "url").limit(sample_rows)
    sample = written(sample.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "blocked"))
    rows = sample.select("url", suffix(F.col("host")).alias("suffix"), "blocked").collect()
    blocked = np.array([r["blocked"] for r in rows], float)
    seen: dict[str, list[float]] = {}
    for r in rows:
        seen.setdefault(r["suffix"], []).append(r["blocked"])
    usual = float(blocked.mean()) if len(rows) else 0.5
    # a suffix of few urls tells little, and a long list would be a long expression
    often = sorted(seen, key=lambda k: (-len(seen[k]), k))[:MOST_SUFFIXES]
    suffixes = {k: (sum(seen[k]) + 10 * usual) / (len(seen[k]) + 10) for k in often}
    found = sample.select("url", "blocked", features(F.col("url"), F.col("host"), F.col("path"), suffixes, usual).alias("x")).collect()
    found.sort(key=lambda r: r["url"])
    forest = boost(np.array([r["x"] for r in found], float).reshape(-1, len(FEATURES)), np.array([r["blocked"] for r in found], float))
    forest.suffixes, forest.usual = suffixes, usual
    return forest


def probability(forest: Forest, values: Column) -> Column:
    """Probability of block from an array of FEATURES; null for null."""

    @F.arrow_udf(T.DoubleType())
    def blocked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = np.full(len(column), np.nan)
            given = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            if len(given):
                flat = column.drop_null().flatten().to_numpy(zero_copy_only=False)
                out[given] = forest(flat.reshape(-1, len(FEATURES)))
            yield pa.array(out, from_pandas=True)

    return blocked(values)


def judged(pages: DataFrame, labelled: DataFrame, rules: dict[str, str] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and block_probability (null where a rule decides) of each row."""
    forest = fit(labelled)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    values = F.when(F.col("rule").isNull(), features(F.col("url"), F.col("host"), F.col("path"), forest.suffixes, forest.usual))
    rows = rows.withColumn("p", probability(forest, values))
    by_rule = F.coalesce(*[F.when(F.col("rule") == name, F.lit(verdict)) for name, verdict in rules.items()], F.lit(None).cast("string"))
    verdict = F.coalesce(by_rule, F.when(F.col("p") >= 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("p").alias("block_probability"))


def labelled_by_host(pages: DataFrame, url_col: str = "url", unwanted: tuple[str, ...] = UNWANTED_HOSTS) -> DataFrame:
    """(url, blocked): urls whose host has one of the unwanted labels are marked 1, others 0."""
    named = F.arrays_overlap(F.split(host(F.col(url_col)), "\\."), F.array(*[F.lit(u) for u in unwanted]))
    return pages.select(F.col(url_col).alias("url"), named.cast("int").alias("blocked"))
