"""One query for each operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, bytenet, lines, minhash, mixing, rollups, rules, secrets, simhash, urls
from tidewell.llm.textkit import shared_folder, written
from tidewell.session import table

VOCABULARY = corpus_pipeline.VOCABULARY

#: Session setting: a Parquet table of labelled urls (url, blocked: 0 or 1) for the url filter.
URL_LABELS = "spark.tidewell.urlLabels"


def op1_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return minhash.against_next(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of quality 1 for every document; learnt from labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out)
    net = bytenet.fit(docs, labels)
    scored = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), bytenet.score(net, F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= bytenet.THRESHOLD, 1).otherwise(0))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url; learnt from the labelled urls that the session names, or else
    from the pages' own urls under a list of unwanted hosts, as the tables hold no labelled urls."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    given = spark.conf.get(URL_LABELS, None)
    return urls.judged(pages, spark.read.parquet(given) if given else urls.labelled_by_host(pages))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes that they decode to, as digests."""
    vocabulary = bpe.load_vocabulary(spark, public_tokenizers.path(VOCABULARY))
    ids = table(spark, sf_dir, "documents").select("doc_id", bpe.encode(vocabulary, F.col("text")).alias("ids"))
    both = ids.select("doc_id", "ids", bpe.decode(vocabulary, F.col("ids")).alias("decoded"))
    return both.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = secrets.scanned(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[secrets.counted(F.col("base"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand earlier, exactly or within one edit."""
    return lines.deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op8_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after four batches: every document by its words, every count revised to byte-level BPE, every document
    of the first source deleted, and inserted again; one batch is sent twice, and the first two are compacted."""
    vocabulary = bpe.load_vocabulary(spark, public_tokenizers.path(VOCABULARY))
    docs = table(spark, sf_dir, "documents")
    tokens = (F.length(bpe.encode(vocabulary, F.col("text"))) / 4).cast("long")
    counts = written(docs.select("doc_id", "source", "lang", mixing.word_count(F.col("text")).alias("words"), tokens.alias("tokens")))
    by_words = counts.select("doc_id", "source", "lang", F.lit("words/1").alias("tokenizer_version"), F.col("words").alias("n_tokens"))
    by_bpe = counts.select("doc_id", "source", "lang", F.lit("byte_bpe_50k/1").alias("tokenizer_version"), F.col("tokens").alias("n_tokens"))
    first = by_bpe.agg(F.min("source")).first()[0]
    rest = by_bpe.where(~F.col("source").eqNullSafe(F.lit(first)))
    rollup = rollups.Rollup(spark, shared_folder(spark))
    rollup.commit("words", rollups.inserts(by_words))
    rollup.commit("bpe", rollups.changes(by_words, by_bpe))
    rollup.compact()
    rollup.commit("bpe", rollups.changes(by_words, by_bpe))
    rollup.commit("deleted", rollups.changes(by_bpe, rest))
    rollup.commit("restored", rollups.changes(rest, by_bpe))
    return rollup.totals()


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return rules.judged(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("hash")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_fingerprints": op1_minhash_fingerprints,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_url_filter": op3_url_filter,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_secret_scan": op5_secret_scan,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_rollups": op8_token_rollups,
    "op9_quality_rules": op9_quality_rules,
    "op10_source_mix": op10_source_mix,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {}
