"""Quality rules (operator 9): text statistics and learned decision lists, all in built-in functions.

Statistics are computed inside each row with array functions, so a document's words never leave their row.
From a bounded sample of labelled statistics the driver learns an ordered decision list by sequential covering:
on one part of the sample it grows a conjunction of thresholds by information gain, on the other it prunes the
conjunction, keeps it if it is precise enough there, removes what the rule covers and goes on. The list becomes
one ordered conditional expression.

Null texts count as empty; they have no words and fail the base rule. Repeated rows are judged alike. Statistics
are named columns of their own frame, and only the named id and text are read, so other columns may clash.
Without labels of both kinds the list is empty and the base rule alone decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.textkit import WORD_SEPARATORS, written

# The characters that count as symbols, the words of a window, and the base rule's limits.
SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20

#: Labelled rows that the driver learns from, at most; the smallest hashes of their ids are taken.
SAMPLE_ROWS = 4000

FEATURES = ("n_words", "mean_word_chars", "symbols_per_word", "dup_lines", "repeated_share")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, although lambdas use it again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(grams: Column) -> Column:
    """Positions that the windows cover whose hash occurs again."""

    def positions(ordered: Column) -> Column:
        def twice(item: Column, at: Column) -> Column:
            previous, following = F.get(ordered, at - 1), F.get(ordered, at + 1)
            return F.coalesce(previous["h"] == item["h"], F.lit(False)) | F.coalesce(following["h"] == item["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(ordered, twice), lambda x: x["i"]))

    def length(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, at: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(starts, at + 1) - p, F.lit(WINDOW_WORDS))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    ordered = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(ordered, positions), length)


def _repeated(words: Column) -> Column:
    def windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW_WORDS)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW_WORDS)]))

    grams = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    some = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(_covered(g)))
    return F.when(F.size(words) < WINDOW_WORDS, 0).otherwise(some)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and, as longs, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, WORD_SEPARATORS), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    cut = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id",
        let(words, lambda w: F.struct(F.size(w).alias("n"), F.aggregate(w, F.lit(0), lambda total, x: total + F.length(x)).alias("chars"), _repeated(w).alias("repeated"))).alias("word"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("dup_lines"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("symbols"),
    )
    return cut.select(
        "doc_id",
        F.col("word.n").cast("long").alias("n_words"),
        F.col("word.chars").cast("long").alias("word_chars"),
        F.col("symbols").cast("long").alias("n_symbols"),
        F.col("dup_lines").cast("long").alias("n_dup_lines"),
        F.col("word.repeated").cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    """The base rule over the columns of statistics()."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def features() -> dict[str, Column]:
    """What thresholds are learned on, over the columns of statistics()."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "repeated_share": F.col("n_repeat_words") / words,
    }


@dataclass(frozen=True)
class Test:
    """feature > threshold, or feature <= threshold."""

    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.threshold) == self.above


@dataclass
class DecisionList:
    """Conjunctions in order; the first that holds rejects, and what none rejects is kept."""

    rules: list[tuple[Test, ...]] = field(default_factory=list)

    def keeps(self, row: dict) -> bool:
        return not any(all(t.holds(row) for t in rule) for rule in self.rules)

    def verdict(self) -> Column:
        """The list as one ordered conditional expression, true for kept rows."""
        columns, chain = features(), F
        for rule in self.rules:
            tests = [columns[t.feature] > t.threshold if t.above else columns[t.feature] <= t.threshold for t in rule]
            condition = tests[0]
            for test in tests[1:]:
                condition = condition & test
            chain = chain.when(condition, F.lit(False))
        return F.lit(True) if chain is F else chain.otherwise(F.lit(True))


def _gain(found: list[dict], p: int, n: int) -> float:
    """FOIL's gain of a test that leaves ``found`` of p rejected and n kept rows."""
    p1 = sum(row["bad"] for row in found)
    if not p1:
        return 0.0
    return p1 * (math.log2(p1 / len(found)) - math.log2(p / (p + n)))


def _candidates(rows: list[dict], cuts: int) -> list[Test]:
    tests = []
    for name in FEATURES:
        values = sorted({row[name] for row in rows})
        step = max(1, (len(values) - 1) // cuts)
        for i in range(0, len(values) - 1, step):
            middle = (values[i] + values[i + 1]) / 2
            tests += [Test(name, True, middle), Test(name, False, middle)]
    return tests


def learn(rows: list[dict], precision: float = 0.95, support: int = 3, most_rules: int = 12, most_tests: int = 3, cuts: int = 40) -> DecisionList:
    """The list for rows with ``bad`` and the features: two thirds grow rules, the rest prunes and judges them."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    out = DecisionList()

    def worth(rule: tuple[Test, ...]) -> tuple[float, int]:
        found = [r for r in prune if all(t.holds(r) for t in rule)]
        bad = sum(r["bad"] for r in found)
        return (bad + 1) / (len(found) + 2), bad

    while len(out.rules) < most_rules and any(r["bad"] for r in grow):
        covered, rule = grow, ()
        while len(rule) < most_tests and any(not r["bad"] for r in covered):
            p = sum(r["bad"] for r in covered)
            scored = [(_gain([r for r in covered if t.holds(r)], p, len(covered) - p), -i, t) for i, t in enumerate(_candidates(covered, cuts))]
            best = max(scored, default=(0.0, 0, None))
            if best[0] <= 0:
                break
            rule += (best[2],)
            covered = [r for r in covered if best[2].holds(r)]
        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda x: worth(x)[0])
        share, bad = worth(rule)
        found = [r for r in grow if all(t.holds(r) for t in rule)]
        clean = sum(not r["bad"] for r in found)
        if bad < support or clean > (1 - precision) * len(found) or share < precision - 1 / (bad + 2):
            break
        out.rules.append(rule)
        grow, prune = ([r for r in part if not all(t.holds(r) for t in rule)] for part in (grow, prune))
    return out


def sampled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, quality, text), as a table: the labelled documents with the ``rows`` smallest hashes of their ids, one text an id.

    A document labelled twice has its smaller label; of several texts of one id the one with the smallest hash is taken.
    """
    marked = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return written(found.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """A decision list from the statistics of at most ``sample_rows`` labelled documents that pass the base rule."""
    sample = sampled(docs, labels, sample_rows)
    found = statistics(sample).where(~base_failed()).join(F.broadcast(sample.select("doc_id", "quality")), "doc_id")
    rows = found.select("doc_id", (F.col("quality") == 0).alias("bad"), *[c.alias(n) for n, c in features().items()]).collect()
    return learn([r.asDict() for r in sorted(rows, key=lambda r: (r["doc_id"] * 2654435761 % 2**32, tuple(r)))])


def judged(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """statistics() with base_failed and kept."""
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.verdict())


def kept_rows(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The rows of docs that the base rule and the list keep, all columns unchanged."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    return judged(rows.withColumnRenamed("row", "doc_id"), rules).where("kept").select("doc_id.*")
