"""A corpus from raw documents to token ids: five stages, each written as Parquet and read again by the next.

The quality stage removes rejected documents, line dedup shortens texts, near-dedup leaves one document of each
group, mixing repeats or leaves out documents towards the sources' targets, and the last stage encodes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, lines, mixing, rules, similar
from tidewell.llm.textkit import written
from tidewell.session import table

VOCABULARY = "byte_bpe_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned list keep."""
    return rules.kept_rows(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; n_chars follows the text."""
    found = lines.deduplicated(docs)
    return found.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs of Jaccard similarity 0.8 or more (five-word shingles) connect."""
    return similar.representatives(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.drawn(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed little-endian uint32) of every document, and whether they decode to its text."""
    vocabulary = bpe.load_vocabulary(spark, public_tokenizers.path(VOCABULARY))
    ids = docs.select("doc_id", "lang", "source", "text", bpe.encode(vocabulary, F.col("text")).alias("ids"))
    same = bpe.decode(vocabulary, F.col("ids")) == F.coalesce("text", F.lit("")).cast("binary")
    return ids.select("doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("lossless"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("encoding", encoding),
]

#: Learned rules, Levenshtein classes over a deletion index, similarity joins and BPE are beyond SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
