"""Secret scans (operator 5), in built-in functions only.

Base spans come from three patterns, each searched leftmost and without overlap; a match that is too short is
dropped after the search. Positions are running lengths of the pieces between matches, in code points, end
exclusive.

The method adds spans of random-looking strings that no base span touches. A candidate is a maximal run of
letters, digits and + / _ - = of 20 characters or more, however long; its alphabet is inferred as hex, base32, or the classes
of characters in it (capitals, small letters, digits, + and /, _ and -). Three tests weigh it against ordinary text in
that encoding, each as a standard score that grows with randomness:

* runs: changes between letters and digits, or between cases where there are no digits, of which text has few,
* chi-squared: the spread over eight parts of the inferred alphabet, which is wide in a uniform draw and narrow in text,
* serial correlation of neighbouring alphabet positions, which a uniform draw keeps near zero.

The scores are combined into one (Stouffer's weighted sum, each bounded above so that two cannot outvote a third that
speaks for text), and the combined p-values go through a step-up false-discovery procedure in their document, with
weights in proportion to length, as a longer string tells more. What passes is a finding.

Running lengths are summed by blocks, and base spans are blanked out before candidates are searched, so the time for a
text of k spans grows as k ** 1.5, in steps of a few nanoseconds.

Null and empty texts give no spans. Repeated rows are searched alike. Only the named id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.rules import let

# The kinds in their order, their patterns, and the least length of a match or its group.
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST_GROUP, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

# The same matches of the last two kinds: a run is cut nowhere else, so its length can stand in the pattern.
ACCESS_KEPT = "AKIA[A-Z0-9]{16,}"
HEX_KEPT = "[0-9a-f]{24,}"

#: Stands for each character of a base span while candidates are searched.
BLANK = "\x01"
CANDIDATE = "[A-Za-z0-9+/_=\\x01-]{20,}"

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"

# Ordinary text of identifiers, paths and slugs, as measured on the names in source code of 20 characters or more:
# the share of neighbours that change between letters and digits, or between cases; mean and deviation of chi-squared
# by length, of one case and of two; deviation of the serial correlation.
TEXT_DIGIT_CHANGES, TEXT_CASE_CHANGES = 0.09, 0.33
TEXT_SPREAD, TEXT_SPREAD_TWO_CASES = (0.47, 0.17), (0.95, 0.35)
TEXT_SERIAL = 0.3

#: Mean and deviation of the absolute value of a standard normal variable.
HALF_NORMAL = (0.798, 0.603)

#: Weights of runs, chi-squared and serial correlation, and the bounds of each score.
TEST_WEIGHTS = (1.0, 1.0, 0.3)
LEAST_SCORE, MOST_SCORE = -9.0, 4.5

FALSE_DISCOVERY = 0.01

SPANS = "array<struct<start:int,order:int,kind:string,stop:int,token:string>>"


def running(sizes: Column) -> Column:
    """Running sums of an array of ints, by blocks as long as there are blocks."""

    def summed(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda x, y: x + y))
        before = let(totals, lambda t: F.transform(t, lambda _, i: F.aggregate(F.slice(t, 1, i), F.lit(0), lambda x, y: x + y)))
        inside = F.zip_with(blocks, before, lambda b, start: F.transform(b, lambda _, i: F.aggregate(F.slice(b, 1, i + 1), start, lambda x, y: x + y)))
        return F.flatten(inside)

    def cut(width: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(sizes) / width).cast("int") - 1), lambda i: F.slice(sizes, i * width + 1, width))

    blocks = let(F.ceil(F.sqrt(F.size(sizes).cast("double"))).cast("int"), cut)
    return F.when(F.size(sizes) == 0, sizes).otherwise(let(blocks, summed))


def spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """array<struct<start, order, kind, stop, token>> of the pattern's matches in text; keep(token) drops some."""
    order = {"assign": 0, "access": 1, "hex": 2, "random": 3}[kind]

    def span(stop: Column, token: Column) -> Column:
        start = stop - F.length(token)
        return F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), stop.alias("stop"), token.alias("token"))

    def placed(tokens: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(tokens)), tokens, lambda piece, token: F.length(piece) + F.length(token))
        found = F.when(F.size(tokens) > 0, F.zip_with(let(steps, running), tokens, span))
        return F.coalesce(found, F.array().cast(SPANS))

    all_spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return all_spans if keep is None else F.filter(all_spans, lambda s: keep(s["token"]))


def blanked(text: Column, pattern: str, keep=None) -> Column:
    """text with BLANK for each character of the pattern's matches, of those that keep(token) keeps."""

    def joined(source: Column, tokens: Column) -> Column:
        blank = lambda token: F.repeat(F.lit(BLANK), F.length(token))
        new = blank if keep is None else lambda token: F.when(keep(token), blank(token)).otherwise(token)
        pieces = F.split(source, pattern, -1)
        parts = let(pieces, lambda p: F.concat(F.zip_with(F.slice(p, 1, F.size(tokens)), tokens, lambda piece, token: F.concat(piece, new(token))), F.slice(p, -1, 1)))
        return F.when(F.size(tokens) == 0, source).otherwise(F.array_join(parts, ""))

    return let(text, lambda source: let(F.regexp_extract_all(source, F.lit(pattern), F.lit(0)), lambda tokens: joined(source, tokens)))


def _long_enough(token: Column) -> Column:
    return F.length(F.regexp_extract(token, ASSIGN, 2)) >= LEAST_GROUP


def base_spans(text: Column) -> Column:
    """The three kinds, by start, then by kind."""
    return F.array_sort(F.concat(spans(text, ASSIGN, "assign", _long_enough), spans(text, ACCESS_KEPT, "access"), spans(text, HEX_KEPT, "hex")))


def _normal_tail(z: Column) -> Column:
    """About P(Z > z), by a logistic form of the normal distribution."""
    return 1 / (1 + F.exp(1.5976 * z + 0.070565998 * z * z * z))


def encoding(token: Column) -> Column:
    """Struct of the inferred alphabet, the body to look up in it, and whether it has digits and two cases."""
    hexadecimal = token.rlike("^[0-9a-f-]+$") | token.rlike("^[0-9A-F-]+$")
    base32 = token.rlike("^[A-Z2-7=]+$")
    classes = (("[A-Z]", LETTERS[:26]), ("[a-z]", LETTERS[26:]), ("[0-9]", DIGITS), ("[+/]", "+/"), ("[_-]", "_-"))
    present = F.concat(*[F.when(token.rlike(pattern), F.lit(symbols)).otherwise(F.lit("")) for pattern, symbols in classes])
    alphabet = F.when(hexadecimal, F.lit("0123456789abcdef")).when(base32, F.lit("abcdefghijklmnopqrstuvwxyz234567")).otherwise(present)
    body = F.when(hexadecimal | base32, F.lower(token)).otherwise(token)
    digits = hexadecimal | base32 | token.rlike("[0-9]")
    cases = ~hexadecimal & ~base32 & token.rlike("[A-Z]") & token.rlike("[a-z]")
    return F.struct(token.alias("token"), alphabet.alias("alphabet"), body.alias("body"), digits.alias("digits"), cases.alias("cases"))


def _changes(kinds: Column) -> Column:
    return F.length(F.regexp_replace(kinds, "(.)(?=\\1)", "")) - 1


def runs_score(setup: Column) -> Column:
    """More changes between letters and digits, or cases, than text has."""
    plain = F.translate(setup["token"], LETTERS + DIGITS + "+/_=-", "l" * 52 + "d" * 10)
    cased = F.translate(setup["token"], LETTERS + "+/_=-", "u" * 26 + "l" * 26 + "m" * 5)

    def score(kinds: Column, rate: float, some: Column) -> Column:
        places = F.greatest(F.length(plain) - 1, F.lit(1)).cast("double")
        share = F.when(some, _changes(kinds) / F.greatest(F.length(kinds) - 1, F.lit(1))).otherwise(0.0)
        return ((share - rate) * places - 0.5) / F.sqrt(rate * (1 - rate) * places)

    return F.when(setup["digits"], score(plain, TEXT_DIGIT_CHANGES, F.lit(True))).otherwise(score(cased, TEXT_CASE_CHANGES, setup["cases"]))


def spread_score(positions: Column, size: Column, cases: Column) -> Column:
    """A smaller chi-squared, over eight parts of the alphabet in their shares of it, than text has."""
    n = F.size(positions).cast("double")

    def counted(parts: Column) -> Column:
        def part(k: Column) -> Column:
            share = F.greatest(F.ceil((k + 1) * size / 8) - F.ceil(k * size / 8), F.lit(1)) / size
            off = F.size(F.filter(parts, lambda v: v == k)) - n * share
            return off * off / (n * share)

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(7)), part), F.lit(0.0), lambda total, c: total + c)

    chi = let(F.transform(positions, lambda v: F.floor(v * 8 / size).cast("int")), counted)
    scores = [(mean - chi / n) / deviation for mean, deviation in (TEXT_SPREAD_TWO_CASES, TEXT_SPREAD)]
    return F.when(cases, scores[0]).otherwise(scores[1])


def serial_score(positions: Column, size: Column) -> Column:
    """A smaller correlation of neighbours, in absolute value, than text has."""
    centre, variance = (size - 1) / 2, (size * size - 1) / 12
    products = F.zip_with(F.slice(positions, 1, F.size(positions) - 1), F.slice(positions, 2, F.size(positions) - 1), lambda v, w: (v - centre) * (w - centre))
    serial = F.aggregate(products, F.lit(0.0), lambda total, v: total + v) / (variance * (F.size(positions) - 1))
    return (HALF_NORMAL[0] - F.abs(serial) / TEXT_SERIAL) / HALF_NORMAL[1]


def randomness(token: Column) -> Column:
    """The combined score: standard normal or less for ordinary text, the higher the more random."""

    def tested(setup: Column) -> Column:
        found = F.filter(F.transform(F.split(setup["body"], ""), lambda c: F.when(c != "", F.instr(setup["alphabet"], c) - 1).otherwise(-1)), lambda v: v >= 0)
        size = F.length(setup["alphabet"]).cast("double")

        def combined(positions: Column) -> Column:
            scores = (runs_score(setup), spread_score(positions, size, setup["cases"]), serial_score(positions, size))
            total = F.lit(0.0)
            for weight, score in zip(TEST_WEIGHTS, scores, strict=True):
                total = total + weight * F.greatest(F.lit(LEAST_SCORE), F.least(F.lit(MOST_SCORE), score))
            return F.when(F.size(positions) < 2, LEAST_SCORE).otherwise(total / sum(w * w for w in TEST_WEIGHTS) ** 0.5)

        return let(found, combined)

    return let(encoding(token), tested)


def random_spans(text: Column, base: Column) -> Column:
    """Candidates that no base span touches and that the battery and the document's false-discovery control let through."""

    def weighed(found: Column) -> Column:
        mean = F.aggregate(found, F.lit(0.0), lambda total, s: total + F.length(s["token"])) / F.size(found)
        chance = lambda s: _normal_tail(F.greatest(randomness(s["token"]), F.lit(-8.0)))
        return let(mean, lambda m: F.transform(found, lambda s: F.struct(s.alias("span"), (chance(s) * m / F.length(s["token"])).alias("q"))))

    def controlled(items: Column) -> Column:
        ordered = F.array_sort(F.transform(items, lambda x: x["q"]))
        passed = F.transform(ordered, lambda q, i: F.when(q <= FALSE_DISCOVERY * (i + 1) / F.size(items), q).otherwise(-1.0))
        kept = let(F.array_max(passed), lambda limit: F.filter(items, lambda x: x["q"] <= limit))
        return F.transform(kept, lambda x: x["span"])

    clear = F.translate(text, BLANK, " ")
    hidden = blanked(blanked(blanked(clear, ASSIGN, _long_enough), ACCESS_KEPT), HEX_KEPT)
    free = F.when(F.size(base) == 0, clear).otherwise(hidden)
    found = let(free, lambda source: spans(source, CANDIDATE, "random", lambda token: F.instr(token, BLANK) == 0))
    return let(found, lambda x: F.when(F.size(x) == 0, x).otherwise(let(weighed(x), controlled)))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (base and random ones): array<struct<start, order, kind, stop, token>> by start, then kind."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    based = texts.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    return based.select("doc_id", "base", F.array_sort(F.concat("base", random_spans(F.col("text"), F.col("base")))).alias("spans"))


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def counted(found: Column, kind: str) -> Column:
    """Spans of a kind, as a long."""
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
