"""Random strings of any length."""

import math
import random
import re
import string
import time

from tidewell.llm import secrets


def test_long_random_strings(spark):
    random.seed(13)
    alnum = string.ascii_letters + string.digits
    sizes = [128, 256, 400, 512, 513, 3000]
    texts = [(n, f"the key {''.join(random.choice(alnum) for _ in range(n))} here") for n in sizes for _ in range(40)]
    texts += [(0, "x " + "ab12" * 500), (0, "x " + "some-words-in-a-slug-" * 100)]
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: [(s["start"], s["stop"]) for s in r["spans"] if s["kind"] == "random"] for r in secrets.scanned(frame).collect()}
    for n in sizes:
        whole = [found[i] == [(8, 8 + n)] for i, (size, _) in enumerate(texts) if size == n]
        print(n, sum(whole))
        assert sum(whole) >= 38, n
    assert found[len(texts) - 1] == found[len(texts) - 2] == []


def brute_score(token):
    """The battery, in plain Python."""
    lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    cases = has_digits = False
    if re.fullmatch("[0-9a-f-]+|[0-9A-F-]+", token):
        alphabet, body, has_digits = digits + "abcdef", token.lower(), True
    elif re.fullmatch("[A-Z2-7=]+", token):
        alphabet, body, has_digits = lower + "234567", token.lower(), True
    else:
        alphabet = "".join(x for x in (upper, lower, digits, "+/", "_-") if set(x) & set(token))
        body, has_digits = token, bool(set(digits) & set(token))
        cases = bool(set(upper) & set(token) and set(lower) & set(token))
    x = [alphabet.index(c) for c in body if c in alphabet]
    n, size = len(x), len(alphabet)
    if n < 2:
        return -9.0
    plain = ["d" if c in digits else "l" for c in token if c.isalnum()]
    kinds = plain if has_digits else ["u" if c in upper else "l" if c in lower else "m" for c in token]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, len(kinds) - 1) if has_digits or cases else 0.0
    rate, places = (0.09 if has_digits else 0.33), max(1, len(plain) - 1)
    runs = ((changes - rate) * places - 0.5) / math.sqrt(rate * (1 - rate) * places)
    chi = 0.0
    for k in range(8):
        share = max(1, math.ceil((k + 1) * size / 8) - math.ceil(k * size / 8)) / size
        chi += (sum(v * 8 // size == k for v in x) - n * share) ** 2 / (n * share)
    spread = (0.95 - chi / n) / 0.35 if cases else (0.47 - chi / n) / 0.17
    centre = (size - 1) / 2
    serial = sum((a - centre) * (b - centre) for a, b in zip(x, x[1:], strict=False)) / ((size * size - 1) / 12 * (n - 1))
    parts = [max(-9.0, min(4.5, z)) for z in (runs, spread, (0.798 - abs(serial) / 0.3) / 0.603)]
    return (parts[0] + parts[1] + 0.3 * parts[2]) / math.sqrt(2.09)


def brute_random(text, base):
    """(start, stop) of the candidates that the step-up procedure lets through."""
    found = [m.span() for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text)]
    found = [(a, b) for a, b in found if not any(x < b and a < y for x, y in base)]
    if not found:
        return []
    mean = sum(b - a for a, b in found) / len(found)
    tail = lambda z: 1 / (1 + math.exp(1.5976 * z + 0.070565998 * z**3))
    weighed = [(tail(max(-8.0, brute_score(text[a:b]))) * mean / (b - a), (a, b)) for a, b in found]
    ordered = sorted(q for q, _ in weighed)
    passed = [q for i, q in enumerate(ordered) if q <= 0.01 * (i + 1) / len(ordered)]
    return sorted(span for q, span in weighed if passed and q <= max(passed))


KINDS = {"hex": "0123456789ABCDEF", "base32": string.ascii_uppercase + "234567", "alnum": string.ascii_letters + string.digits, "url": string.ascii_letters + string.digits + "-_", "lower": string.ascii_lowercase + string.digits}
NAMES = ["ThisIsSomeCamelCaseIdentifier", "test_enable_raises_error_if_no_capability", "verify_http_server_response", "com/DTDs/PropertyList-1", "2024-01-02T10-20-30_report", "some-long-url-slug-with-words-2024", "abcdefghijklmnopqrstuvwxyz0123456789", "a" * 40, "ab12" * 9, "=" * 30, "0123456789" * 4, "MAX_RETRIES_BEFORE_FAILURE_2"]


def test_battery_against_brute_force(spark):
    random.seed(21)
    draw = lambda kind, n: "".join(random.choice(KINDS[kind]) for _ in range(n))
    texts = []
    for _ in range(250):
        parts = [random.choice([random.choice(NAMES), draw(random.choice(list(KINDS)), random.choice([20, 24, 32, 40, 64, 200])), "plain words", "token=" + draw("url", 24), "f" * 30 + "+" + draw("alnum", 24), "\x01é"]) for _ in range(random.randrange(8))]
        texts.append(" ".join(parts))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in secrets.scanned(frame).collect():
        base = [(s["start"], s["stop"]) for s in row["base"]]
        assert [(s["start"], s["stop"]) for s in row["spans"] if s["kind"] == "random"] == brute_random(texts[row["doc_id"]], base), texts[row["doc_id"]]


def test_recall_and_names(spark):
    random.seed(22)
    rows = [(kind, n, "".join(random.choice(KINDS[kind]) for _ in range(n))) for kind in KINDS for n in (40, 64, 600, 2000) for _ in range(100)]
    rows += [("name", 0, name) for name in NAMES]
    frame = spark.createDataFrame([(i, f"of {t} it") for i, (*_, t) in enumerate(rows)], "doc_id long, text string")
    found = {r["doc_id"]: [(s["start"], s["stop"]) for s in r["spans"] if s["kind"] == "random"] for r in secrets.scanned(frame).collect()}
    for kind in KINDS:
        for n in (40, 64, 600, 2000):
            hit = [found[i] == [(3, 3 + n)] for i, (k, m, _) in enumerate(rows) if (k, m) == (kind, n)]
            assert sum(hit) >= 0.85 * len(hit), (kind, n, sum(hit))
        assert sum(found[i] != [] for i, r in enumerate(rows) if r[0] == kind) >= 360, kind
    assert not any(found[i] for i, r in enumerate(rows) if r[0] == "name")


def test_many_spans_in_one_text(spark):
    random.seed(23)
    seconds = {}
    for many in (1000, 8000):
        text = " ".join(f"token=abcdef{i} " + "".join(random.choice(KINDS["alnum"]) for _ in range(40)) for i in range(many // 2))
        frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
        row = secrets.scanned(frame).first()
        assert len(row["base"]) == many // 2 and len(row["spans"]) > 0.9 * many
        assert all(text[s["start"] : s["stop"]] == s["token"] for s in row["spans"])
        began = time.perf_counter()
        secrets.scanned(frame).first()
        seconds[many] = time.perf_counter() - began
    assert seconds[8000] < 16 * seconds[1000] + 2
