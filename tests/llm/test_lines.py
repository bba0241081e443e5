"""Line dedup on short lines."""

import random

from tests.llm.test_corpus import brute_lines
from tidewell.llm import lines


def test_short_lines_are_deduplicated(spark):
    random.seed(12)
    docs = [(i, "\n".join("".join(random.choice("abcdefé1") for _ in range(random.randrange(7))) for _ in range(6))) for i in range(40)]
    docs += [(100, "Stteen Erachtz.\n\n  \nletzte."), (101, "Stteen Erachtz.\n\nletzte.\nAnders hier.")]
    got = {r["doc_id"]: r["text"] for r in lines.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[101] == "\nAnders hier."
    assert sorted(got.items()) == sorted(brute_lines(docs))


def test_repeated_rows_keep_their_lines_once(spark):
    docs = [(1, "only here once\n\nand a second line")] * 3 + [(None, "x y z\n  ")] * 2 + [(2, None)] * 2 + [(3, "not a repeat\nx y q")]
    frame = spark.createDataFrame([(*d, i) for i, d in enumerate(docs)], "doc_id long, text string, first int")
    got = lines.deduplicated(frame)
    rows = sorted(((r["doc_id"], r["text"], r["n_dropped"]) for r in got.collect()), key=str)
    assert rows == sorted([(1, docs[0][1], 0), (1, "", 2), (1, "", 2), (None, "  ", 1), (None, "  ", 1), (2, None, 0), (2, None, 0), (3, docs[-1][1], 0)], key=str)
    assert sorted(r["first"] for r in got.collect()) == list(range(len(docs)))
