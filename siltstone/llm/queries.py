"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import (curves, fim, licenses, mixing, packing, rules, simhash, substrings, tokens, toxicity, urlfilter,
                           warc, wavelet, whitening)
from siltstone.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards written and read back."""
    docs = table(spark, sf_dir, "documents")
    shards = wavelet.write_shards(docs, tokens.vocabulary("byte_bpe_50k.json"))
    return wavelet.documents(shards, "doc_id", docs.schema["doc_id"].dataType.simpleString())


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives and index written; every record read back through the index."""
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    found = warc.read_all(warc.write_archive(pages))
    return found.select(F.col("page").cast(kind).alias("page_id"), F.col("size").alias("payload_bytes"),
                        F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"),
                        F.col("refers").cast(kind).alias("refers_to"))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the base policy and the current one."""
    entries = rules.ledger(table(spark, sf_dir, "documents"), "doc_id")
    base = rules.verdict(F.col("failed"), "base")
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          (~base).alias("base_failed"), (base & rules.verdict(F.col("failed"))).alias("kept"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known(spark))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    found = curves.neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return found.select(F.col("query_id").cast("bigint"), "rank", F.col("vec_id").cast("bigint"), "score")


def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = urlfilter.entries(spark, urlfilter.RULES, 1).union(urlfilter.entries(spark, urlfilter.LISTED, 0))
    return urlfilter.judged(table(spark, sf_dir, "pages"), listed)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the rewritten texts and of the texts rebuilt from them."""
    found = fim.transformed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                        F.sha2("output", 256).alias("output_sha256"),
                        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of what is left of every text without the passages that occur earlier."""
    found = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_simhash, op3_wavelet, op4_warc, op5_rules, op6_toxicity, op7_licenses,
                                   op8_mixing, op9_curves, op10_urlfilter, op11_fim, op12_substrings, op13_whitening)}
