"""BPE against the tiktoken library, an exact round trip, and hand-made edge cases."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from tidewell.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as file:
        return bpe.Vocabulary.from_file(file.read())


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def encoded(vocabulary, texts):
    parts = [t.encode() for t in texts]
    edges = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    ids, counts = vocabulary.encoded(b"".join(parts), edges)
    assert vocabulary.decoded(ids)[0].tobytes() == b"".join(parts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_perfect_hash_is_minimal(vocabulary):
    assert sorted(vocabulary.hash.slot_of.tolist()) == list(range(len(vocabulary.ranks)))
    assert all(vocabulary.find(t) == r for t, r in list(vocabulary.ranks.items())[::97])
    assert vocabulary.find(b"surely no token of this vocabulary") is None


def test_random_texts(vocabulary, library):
    random.seed(1)
    alphabet = list(" '\n\t\r\x0babcsterlvdmS1²½٣!.,ñé中  　𝔘😀") + ["'ll", "'ve", "'re", " the", "  "]
    texts = ["".join(random.choice(alphabet) for _ in range(random.randrange(40))) for _ in range(4000)]
    assert encoded(vocabulary, texts) == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn", "Co"], max_codepoint=0x3000), max_size=30), min_size=1, max_size=5))
def test_any_texts(vocabulary, library, texts):
    assert encoded(vocabulary, texts) == [library.encode_ordinary(t) for t in texts]


def test_long_runs(vocabulary, library):
    texts = ["a" * 50_000, " " * 9_999 + "x", "", "ab" * 3000 + "'s", "\n" * 500]
    assert encoded(vocabulary, texts) == [library.encode_ordinary(t) for t in texts]


def test_memory_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    texts = [f"zqxj{i}kwvv{i}qz" for i in range(100)]
    first = encoded(vocabulary, texts)
    assert len(vocabulary.young) <= 10 and encoded(vocabulary, texts) == first


def test_query(spark, library):
    import hashlib

    rows = {r["doc_id"]: r for r in queries.op4_bpe_codec(spark, SF).collect()}
    for doc in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = np.array(library.encode_ordinary(doc["text"]), "<u4")
        row = rows[doc["doc_id"]]
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert row["decoded_sha256"] == hashlib.sha256(doc["text"].encode()).hexdigest()


def test_edges(spark):
    vocabulary = bpe.load_vocabulary(spark, PATH)
    frame = spark.createDataFrame([(1, None, 5), (2, "", 6), (2, "x", 7), (2, "x", 7)], "doc_id long, text string, ids long")
    rows = frame.select("doc_id", bpe.encode(vocabulary, F.col("text")).alias("packed")).withColumn("decoded", bpe.decode(vocabulary, F.col("packed")))
    assert sorted((r["doc_id"], bytes(r["decoded"])) for r in rows.collect()) == [(1, b""), (2, b""), (2, b"x"), (2, b"x")]
    assert frame.limit(0).select(bpe.encode(vocabulary, F.col("text"))).count() == 0


def test_long_texts_in_pieces(spark, library, monkeypatch):
    random.seed(9)
    text = "".join(random.choice(["word", " ", "  ", "\n", "é ", "\u00a0 ", "'s ", "9", "!? "]) for _ in range(400_000))
    assert b"".join(bpe.pieces(text.encode(), 1000)) == text.encode() and len(list(bpe.pieces(text.encode(), 1000))) > 100
    vocabulary = bpe.load_vocabulary(spark, PATH)
    rows = spark.createDataFrame([(1, text * 6), (2, "x")], "doc_id long, text string").select("doc_id", bpe.encode(vocabulary, F.col("text")).alias("ids"), "text")
    rows = rows.withColumn("decoded", bpe.decode(vocabulary, F.col("ids"))).collect()
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["text"]) and bytes(r["decoded"]).decode() == r["text"]
